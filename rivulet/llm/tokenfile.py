"""Token files: frequency-ranked ids in byte-aligned variable-length codes with separate control bytes.

Ids are replaced by their rank in the corpus' own counts, so the commonest take one byte. Four
codes share a control byte of two bits each (bytes less one); control and data bytes are apart,
so that a decoder looks up lengths and gathers by table for whole arrays at a time.

Files are Parquet that Spark writes (any store, with its commit protocol): one row for each
document in ascending doc_id order within its `part`, with the ids `at` before it there, the
number of ids, control and data bytes. Parts in order hold the corpus; the rank table is beside
them. A document's start is summed in two levels: within its part, and over the parts.

Null and empty texts have the end id alone. Repeated doc_ids are all written, tied by text. An
empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rivulet.llm.common import discard, documents, id_cuts, partitions, places, shared_path, written
from rivulet.llm.tokens import VOCAB, encoder, forget, tokenizer_path

END = 2
#: The lengths of the four codes of each control byte, first code in the low bits.
LENGTHS = (((np.arange(256)[:, None] >> (2 * np.arange(4))) & 3) + 1).astype(np.uint8)


def pack(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Control and data bytes of several documents' unsigned 32-bit codes, and where each document's control and data bytes end."""
    n = len(codes)
    extra = (codes > 0xFF).astype(np.uint8)
    if n and codes.max() > 0xFFFF:
        extra += codes > 0xFFFF
        extra += codes > 0xFFFFFF
        raw = np.ascontiguousarray(codes, "<u4").view(np.uint8).reshape(-1, 4)
        data = raw[np.arange(4) <= extra[:, None]]
    else:
        some = np.ones((n, 2), bool)
        some[:, 1] = extra
        data = np.ascontiguousarray(codes, "<u2").view(np.uint8).reshape(-1, 2)[some]
    quads = -(-counts // 4)
    control_ends = np.cumsum(quads)
    padded = np.zeros(4 * int(quads.sum()), np.uint8)
    padded[np.arange(n) + np.repeat(4 * (control_ends - quads) - (np.cumsum(counts) - counts), counts)] = extra
    padded = padded.reshape(-1, 4)
    control = padded[:, 0] | padded[:, 1] << 2 | padded[:, 2] << 4 | padded[:, 3] << 6
    data_ends = np.concatenate(([0], np.cumsum(extra, dtype=np.int64) + np.arange(1, n + 1)))[np.cumsum(counts)]
    return control, data, control_ends, data_ends


def unpack(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The documents' codes, one after another, by table lookup of lengths, then a gather of the bytes at each code's place."""
    n = int(counts.sum())
    if not n:
        return np.zeros(0, np.uint32)
    quads = -(-counts // 4)
    start = 4 * (np.cumsum(quads) - quads) - (np.cumsum(counts) - counts)
    sizes = LENGTHS[control].ravel()[np.arange(n) + np.repeat(start, counts)]
    at = np.cumsum(sizes, dtype=np.int64) - sizes
    whole = data[at].astype(np.uint32)
    wide = np.flatnonzero(sizes > 1)
    for byte in (1, 2, 3):
        if not len(wide):
            break
        whole[wide] |= data[at[wide] + byte].astype(np.uint32) << np.uint32(8 * byte)
        wide = wide[sizes[wide] > byte + 1]
    return whole


def binaries(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column of consecutive pieces of some bytes."""
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column without nulls, and where each value's end."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], offsets[1:] - offsets[0]


def parts_of(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for first in range(0, batch.num_rows, rows):
        yield batch.slice(first, rows)


def tokenized(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """doc_id and ids (two bytes each) of every whole text, written; a text is tokenized once. Each task adds a row with its counts of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, counts, names = encoder(path), np.zeros(VOCAB, "<i8"), ["doc_id", "ids", "counts"]
        for batch in batches:
            for part in parts_of(batch):
                ids, ends = code.encode_many(part.column(1).to_pylist())
                ids = np.insert(ids, ends, end)
                counts += np.bincount(ids, minlength=VOCAB)
                yield pa.RecordBatch.from_arrays([part.column(0), binaries(ids.astype("<u2").view(np.uint8), 2 * (ends + np.arange(1, len(ends) + 1))), pa.nulls(len(ends), pa.binary())], names=names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([counts.tobytes()], pa.binary())], names=names)

    return written(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary, counts binary"), "ids")


def token_counts(ids: DataFrame) -> np.ndarray:
    """Counts of all ids of all documents, summed in the cluster; the driver gets a row for each id."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for x in batch.column(0):
                counts = np.frombuffer(x.as_buffer(), "<i8")
                found = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(counts[found])], names=["id", "n"])

    out = np.zeros(VOCAB, np.int64)
    for i, n in ids.where("counts IS NOT NULL").select("counts").mapInArrow(rows, "id int, n long").groupBy("id").agg(F.sum("n")).collect():
        out[i] = n
    return out


def by_frequency(counts: np.ndarray) -> np.ndarray:
    """id of each rank: the commonest first, ties by id."""
    return np.lexsort((np.arange(len(counts)), -counts)).astype(np.uint32)


def write(docs: DataFrame, folder: str, path: str | None = None, end: int = END) -> None:
    """Writes docs' ids under folder: parts of consecutive doc_ids, and in each the rows' places in ascending doc_id order.

    Codes are made before the shuffle, which so moves fewer bytes; repeated ids are tied by them.
    """
    path, spark = path or tokenizer_path(), docs.sparkSession
    stored = tokenized(docs, path, end)
    ids = by_frequency(token_counts(stored))
    tokens = stored.where("ids IS NOT NULL").select("doc_id", "ids")
    rank = np.zeros(VOCAB, np.uint32)
    rank[ids] = np.arange(VOCAB, dtype=np.uint32)
    cuts = np.array(id_cuts(docs.select("doc_id"), 4 * partitions(spark)), np.int64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for some in parts_of(batch):
                own, ends = joined(some.column(1))
                n = np.diff(ends, prepend=0) // 2
                control, data, control_ends, data_ends = pack(rank[own.view("<u2")], n)
                part = pa.array(places(cuts, some.column(0)))
                yield pa.RecordBatch.from_arrays([part, some.column(0), pa.array(n), binaries(control, control_ends), binaries(data, data_ends)], names=["part", "doc_id", "n_tokens", "control", "data"])

    codes = tokens.mapInArrow(encode, "part int, doc_id long, n_tokens long, control binary, data binary")
    before = Window.partitionBy("part").orderBy("doc_id", "n_tokens", "data", "control").rowsBetween(Window.unboundedPreceding, -1)
    placed = codes.repartition(partitions(spark), "part").withColumn("at", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    placed.select("part", "doc_id", "at", "n_tokens", "control", "data").write.parquet(f"{folder}/tokens")
    spark.createDataFrame([(int(r), int(i)) for r, i in enumerate(ids)], "rank int, id int").coalesce(1).write.parquet(f"{folder}/ranks")
    discard(stored)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """From the files: doc_id, start, n_tokens and `ids` as little-endian unsigned 32-bit integers (binary)."""
    rows = spark.read.parquet(f"{folder}/tokens")
    ids = np.zeros(VOCAB, np.uint32)
    for r, i in spark.read.parquet(f"{folder}/ranks").collect():  # VOCAB rows
        ids[r] = i
    before, base = 0, {}
    for part, n in rows.groupBy("part").agg(F.sum("n_tokens")).orderBy("part").collect():  # a row for each part
        base[part] = before
        before += n

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for some in parts_of(batch):
                part, doc_id, at, n, control, data = some.columns
                starts = pa.array([base[p] + a for p, a in zip(part.to_pylist(), at.to_pylist(), strict=True)], pa.int64())
                counts = np.asarray(n)
                got = ids[unpack(joined(control)[0], joined(data)[0], counts)].astype("<u4")
                yield pa.RecordBatch.from_arrays([doc_id, starts, n, binaries(got.view(np.uint8), 4 * np.cumsum(counts))], names=["doc_id", "start", "n_tokens", "ids"])

    return rows.select("part", "doc_id", "at", "n_tokens", "control", "data").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: all documents written as token files and read back."""
    folder = shared_path(spark, "tokenfile")
    write(documents(spark, sf_dir), folder)
    return read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
