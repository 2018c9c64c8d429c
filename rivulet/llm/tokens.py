"""Tokens of whole texts with a public tokenizer, white-space word by white-space word.

The vocabulary drops white space and never merges across it, so a text's ids are those of its
words in order, and a word's ids can be remembered. A worker remembers a bounded number of
words; forgetting some costs time and changes nothing.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import os
from array import array

import numpy as np
import pyarrow as pa

TOKENIZER = "word_bpe_49k.json"
VOCAB = 49408
MEMORY = 1_000_000
KEPT = 65_536
MARKS = b",."


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class Memory:
    """Words and their ids, one after another."""

    def __init__(self) -> None:
        self.row: dict[bytes, int] = {}
        self.starts, self.lengths, self.flat = array("q"), array("i"), array("I")

    def add(self, words: list[bytes], ids: list) -> None:
        row, starts, lengths, flat = self.row, self.starts, self.lengths, self.flat
        for word, some in zip(words, ids, strict=True):
            row[word] = len(starts)
            starts.append(len(flat))
            lengths.append(len(some))
            flat.extend(some)

    def ids(self, word: bytes) -> array:
        k = self.row[word]
        return self.flat[self.starts[k] : self.starts[k] + self.lengths[k]]


class WordEncoder:
    """Remembers words with A-Z in lower case, as the tokenizer puts them so itself; texts that may hold a special token's string stay as they are.

    When `memory` words are held they become the old ones, and what was old is forgotten; old
    words that are met again are taken over.
    """

    def __init__(self, path: str, memory: int = MEMORY):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.memory = Tokenizer.from_file(path), memory
        self.held, self.old = Memory(), Memory()
        vocab = self.tokenizer.get_vocab()
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.ends[[i for t, i in vocab.items() if suffix and t.endswith(suffix)]] = True
        # whether a word of a-z is one piece that the model sees as it is
        self.marks = {c: self.tokenizer.encode(chr(c), add_special_tokens=False).ids for c in MARKS}
        probe = ("the", "thstinnt", "zqxjv")
        self.direct = bool(suffix) and all([t.id for t in self.tokenizer.model.tokenize(w)] == self.tokenizer.encode(w, add_special_tokens=False).ids for w in probe)

    def _learn(self, words: list[bytes]) -> None:
        """A comma or full stop after a letter of a-z is always a piece of its own, so such words are their stem's ids and the mark's."""
        held, old = self.held, self.old
        row, starts, lengths, flat = held.row, held.starts, held.lengths, held.flat
        tokenize, direct = self.tokenizer.model.tokenize, self.direct
        rest: list[tuple[bytes, bytes, list[int]]] = []
        for word in dict.fromkeys(words):
            if word in old.row:
                ids = old.ids(word)
            else:
                stem, tail = word, []
                if direct and word[-1] in MARKS and len(word) > 1 and 97 <= word[-2] <= 122:
                    stem, tail = word[:-1], self.marks[word[-1]]
                if stem in row:
                    ids = held.ids(stem).tolist() + tail
                elif direct and stem.isalpha() and stem.islower():
                    ids = [t.id for t in tokenize(stem.decode())] + tail
                else:
                    rest.append((word, stem, tail))
                    continue
            row[word] = len(starts)
            starts.append(len(flat))
            lengths.append(len(ids))
            flat.extend(ids)
        for at in range(0, len(rest), 512):
            self._joined(rest[at : at + 512])

    def _joined(self, items: list[tuple[bytes, bytes, list[int]]]) -> None:
        """Stems of letters are one piece each, so they are encoded as one text, and the ids that end a word part them; others one by one."""
        texts = [stem.decode() for _, stem, _ in items]
        letters = [i for i, t in enumerate(texts) if t.isalpha()] if self.direct else []
        got: dict[int, list[int]] = {}
        if len(letters) > 1:
            ids = self.tokenizer.encode_batch_fast([" ".join([texts[i] for i in letters])], add_special_tokens=False)[0].ids
            cuts = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(cuts) == len(letters):
                got = {i: ids[a:b] for i, a, b in zip(letters, [0, *cuts[:-1]], cuts, strict=True)}
        others = [i for i in range(len(texts)) if i not in got]
        if others:
            found = self.tokenizer.encode_batch_fast([texts[i] for i in others], add_special_tokens=False)
            got |= {i: e.ids for i, e in zip(others, found, strict=True)}
        self.held.add([word for word, _, _ in items], [got[i] + tail for i, (_, _, tail) in enumerate(items)])

    def rest(self, kept: int = KEPT) -> None:
        """At a task's end: forgets all words where more than `kept` are held, as an idle worker lives on beside the stages that follow."""
        if len(self.held.row) + len(self.old.row) > kept:
            self.held, self.old = Memory(), Memory()
            give_back()

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a whole text; null: none."""
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of whole texts, one after another, and where each text's end; null: none."""
        if len(self.held.row) > self.memory:
            self.held, self.old = Memory(), self.held
        row = self.held.row
        rows: list[int] = []
        counts = []
        for text in texts:
            raw = (text or "").encode()
            ws = (raw if b"<|" in raw else raw.lower()).split()
            own = [*map(row.get, ws)]
            if None in own:
                places = [i for i, k in enumerate(own) if k is None]
                self._learn([ws[i] for i in places])
                for i in places:
                    own[i] = row[ws[i]]
            rows += own  # type: ignore[arg-type]
            counts.append(len(own))
        at = np.array(rows, np.int64)
        n = np.frombuffer(self.held.lengths, np.int32)[at] if len(at) else np.zeros(0, np.int32)
        ends = np.concatenate(([0], np.cumsum(n, dtype=np.int64)))
        stops = ends[np.cumsum(counts, dtype=np.int64)]
        if not len(at):
            return np.zeros(0, np.uint32), stops
        places_ = np.repeat(np.frombuffer(self.held.starts, np.int64)[at] - ends[:-1], n)
        places_ += np.arange(ends[-1])
        return np.frombuffer(self.held.flat, np.uint32)[places_], stops


@functools.lru_cache(maxsize=2)
def encoder(path: str, memory: int = MEMORY) -> WordEncoder:
    """One for each worker process, file and size of its memory."""
    return WordEncoder(path, memory)


def forget() -> None:
    """Frees a worker's memory of words, where the tasks to come encode no texts."""
    if encoder.cache_info().currsize:
        encoder.cache_clear()
        give_back()


def give_back() -> None:
    """Hands freed memory back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
