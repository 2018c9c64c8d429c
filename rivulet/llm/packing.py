"""Best-fit packing by minimum bin slack.

Documents become token pieces of at most `capacity`; only longer documents are cut. Packing
works on the count of pieces of each length, at most `capacity` numbers however many the
documents. The longest length left opens a sequence; subset sums of the lengths left, held as
bits of one integer, tell the fullest fill; that combination is removed as often as the counts
allow. Each such step uses up a length, so there are few more steps than lengths.

Pieces are then numbered among those of their length (in salted groups, whose sizes are summed
afterwards, so that a length that a third of all pieces share is no single task) and find their
sequence and place by a search in the plan.

Null and empty texts give one piece, the end id alone. Repeated rows are packed each for
itself. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rivulet.llm.common import documents, written
from rivulet.llm.tokens import encoder, tokenizer_path

CAPACITY = 4096
END = 1
SALTS = 256
MEMORY = 262_144  # words that a worker remembers


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length and the checksum of each piece's ids."""
    path = path or tokenizer_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path, MEMORY)
        try:
            for batch in batches:
                out: list[list] = [[], [], [], [], []]
                for first in range(0, batch.num_rows, 256):
                    some = batch.slice(first, 256)
                    flat, ends = code.encode_many(some.column(1).to_pylist())
                    flat = np.insert(flat, ends, end).astype("<u4")
                    ends = ends + np.arange(1, len(ends) + 1)
                    for doc_id, start, stop in zip(some.column(0).to_pylist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                        for k, at in enumerate(range(start, stop, capacity)):
                            part = flat[at : min(at + capacity, stop)]
                            for column, x in zip(out, (doc_id, k, at - start, len(part), zlib.crc32(part)), strict=True):
                                column.append(x)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        finally:
            code.rest()

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def fullest(counts: dict[int, int], seed: int, capacity: int) -> dict[int, int]:
    """The lengths that, with seed, fill a sequence best: a bounded subset-sum over bits.

    Bit s of `reach` says that lengths seen so far can sum to s. The sums before each batch of
    copies are kept to trace the combination back.
    """
    room = capacity - seed
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted(counts, reverse=True):
        left = min(counts[length] - (length == seed), room // length if length else 0)
        some = 1
        while left > 0 and not reach >> room & 1:
            take = min(some, left)
            steps.append((length, take, reach))
            reach |= reach << (take * length) & mask
            left -= take
            some *= 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {seed: 1}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= take * length
    return used


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, rank, copies, first sequence, sequences, offset): from rank on, the pieces of length go, `copies` to each, into that many sequences."""
    left, ranks, rows, first = {k: v for k, v in counts.items() if v}, dict.fromkeys(counts, 0), [], 0
    while left:
        used = fullest(left, max(left), capacity)
        times = min(left[length] // n for length, n in used.items())
        offset = 0
        for length, n in sorted(used.items(), reverse=True):
            rows.append((length, ranks[length], n, first, times, offset))
            offset += n * length
            ranks[length] += n * times
            left[length] -= n * times
            if not left[length]:
                del left[length]
        first += times
    return rows


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """parts with sequence_id and offset. parts must be stored, as it is read three times."""
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)).cast("int"))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    counts = {int(r[0]): int(r[1]) for r in sizes.groupBy("length").agg(F.sum("n")).collect()}  # at most `capacity` rows
    rows = sorted(plan(counts, capacity))
    column = lambda i: np.array([r[i] for r in rows], np.int64)
    length, rank, copies, first, _, offset = (column(i) for i in range(6))
    keys = length << 45 | rank

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, r = (np.asarray(batch.column(batch.schema.get_field_index(x)), np.int64) for x in ("length", "rank"))
            at = np.searchsorted(keys, n << 45 | r, side="right") - 1
            k = r - rank[at]
            own = [batch.column(batch.schema.get_field_index(x)) for x in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(first[at] + k // copies[at]), pa.array(offset[at] + k % copies[at] * n)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).select("length", "salt", "before")
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("k", F.row_number().over(within)).join(before, ["length", "salt"]).withColumn("rank", (F.col("before") + F.col("k") - 1).cast("long"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: all documents in sequences of at most 4096 tokens."""
    return pack(written(pieces(documents(spark, sf_dir)), "pieces"))
