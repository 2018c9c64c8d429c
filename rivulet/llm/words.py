"""Hashes of the words of many texts at once, by array operations over their bytes.

Words part at the ASCII white space; A-Z count as a-z. A word's hash takes its bytes eight at a
time, each step through a mixing that is one to one, so that words of the same length of up to
eight bytes never collide and longer ones only by chance, whatever their pattern. Words of more
than LONG bytes are hashed one by one.
"""

from __future__ import annotations

import numpy as np
import xxhash

LONG = 256
#: The bytes that part words.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    def __call__(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """data: the texts' bytes, one after another; ends: where each ends. The words' hashes, and where each text's end."""
        n = len(data)
        if not n:
            return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
        plain = np.zeros(n + 8, np.uint8)
        plain[:n] = LOWER[data]
        space = SPACE[data]
        # a word starts after a space or at a text's start, and ends before a space or at a text's end
        starts = ~space
        starts[1:] &= space[:-1]
        stops = ~space
        stops[:-1] &= space[1:]
        inner = ends[:-1][(ends[:-1] > 0) & (ends[:-1] < n)]
        starts[inner] |= ~space[inner]
        stops[inner - 1] |= ~space[inner - 1]
        start = np.flatnonzero(starts)
        size = np.flatnonzero(stops) + 1 - start
        eight = np.ndarray((n + 1,), "<u8", plain, strides=(1,))  # the eight bytes from each place on
        out = mix(size.astype(np.uint64) * STEP)
        out = mix(out ^ (eight[start] & LOW_BYTES[np.minimum(size, 8)]))
        some, at = np.flatnonzero((size > 8) & (size <= LONG)), 8
        while len(some):
            rest = size[some] - at
            out[some] = mix((out[some] + STEP) ^ (eight[start[some] + at] & LOW_BYTES[np.minimum(rest, 8)]))
            some, at = some[rest > 8], at + 8
        for i in np.flatnonzero(size > LONG):
            out[i] = xxhash.xxh3_64_intdigest(plain[start[i] : start[i] + size[i]].tobytes())
        return out, np.searchsorted(start, ends, side="left")
