"""Document fingerprints by consistent weighted sampling.

Words weighted by their count. For each of SAMPLES samples and each term, r and c are gamma
(2, 1) and b uniform, drawn from a hash of the term; with t = floor(ln w / r + b), the term
with the least ln c - r (t - b) - r gives the sample (term, t). Two documents' samples collide
with the probability of their generalised Jaccard similarity, sum of least over sum of greatest
weights. A sample is kept as 16 bits, so unequal samples collide one time in 65,535.

Null and empty texts have no terms: all their samples are 0, which no term has; so they equal
each other and nothing else. Equal texts have equal fingerprints. An empty table gives no rows;
repeated rows each give one.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm.common import documents, id_cuts, partitions, places
from rivulet.llm.words import mix

SAMPLES = 128
MEMORY = 32768
CHUNK = 4096
LIKE = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


class Sampler:
    """Draws r, b and the score at weight 1 of terms, and remembers those of a bounded number."""

    def __init__(self, samples: int = SAMPLES, memory: int = MEMORY):
        self.samples, self.memory, self.row = samples, memory, {}
        self.r, self.b, self.one = (np.empty((memory + CHUNK, samples), np.float32) for _ in range(3))
        self.hash = np.empty(memory + CHUNK, np.uint64)
        self.steps = (np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]

    def _draw(self, terms: list[bytes]) -> None:
        at = len(self.row)
        h = np.array([xxhash.xxh64_intdigest(t) for t in terms], np.uint64)
        x = mix(h[:, None] + self.steps)
        y = mix(x + np.uint64(0xD1B54A32D192ED03))
        unit = lambda v, bits: (v.astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-bits)
        low, third = np.uint64(0xFFFFFF), np.uint64(0x1FFFFF)
        r = -np.log(unit(x >> np.uint64(40), 24) * unit(x >> np.uint64(16) & low, 24))
        c = -np.log(unit(y >> np.uint64(43), 21) * unit(y >> np.uint64(22) & third, 21))
        b = np.minimum(unit(y & third, 21), np.float32(1 - 2.0**-24))
        rows = slice(at, at + len(terms))
        self.r[rows], self.b[rows], self.one[rows], self.hash[rows] = r, b, np.log(np.maximum(c, 1e-30)) + r * b - r, h
        self.row.update(zip(terms, range(at, at + len(terms)), strict=True))

    def __call__(self, weights: dict[bytes, float]) -> np.ndarray:
        """The samples of positive weights, in any order of the terms: of a chunk, ties go to the lower term hash."""
        best, kept = np.full(self.samples, np.inf, np.float32), np.zeros(self.samples, np.uint64)
        terms = sorted(weights) if len(weights) > CHUNK else [*weights]
        for start in range(0, len(terms), CHUNK):
            part = terms[start : start + CHUNK]
            rows = [*map(self.row.get, part)]
            if None in rows:
                new = [t for t, k in zip(part, rows, strict=True) if k is None]
                if len(self.row) + len(new) > self.memory + CHUNK:
                    self.row.clear()
                    new = part
                self._draw(new)
                rows = [*map(self.row.__getitem__, part)]
            at, w = np.array(rows), np.array([*map(weights.__getitem__, part)], np.float32)
            order = np.argsort(self.hash[at])
            at, w = at[order], w[order]
            score = self.one[at]
            many = np.flatnonzero(w != 1)
            t = np.zeros(0, np.float32)
            if len(many):
                r, b = self.r[at[many]], self.b[at[many]]
                t = np.floor(np.log(w[many])[:, None] / r + b)
                score[many] += -r * t
            least = score.argmin(axis=0)
            value = score[least, np.arange(self.samples)]
            place = np.full(len(part), -1)
            place[many] = np.arange(len(many))
            step = np.zeros(self.samples, np.int64)
            held = place[least] >= 0
            if held.any():
                step[held] = t[place[least[held]], np.flatnonzero(held)]
            ids = mix(self.hash[at[least]] + step.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))
            won = value < best
            best[won], kept[won] = value[won], ids[won] % np.uint64(65535) + np.uint64(1)
        return kept.astype(np.uint16)


def terms(text: str) -> Counter:
    return Counter(text.encode().split())


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def printed(samples: np.ndarray) -> str:
    return base64.b64encode(samples.astype("<u2").tobytes()).decode()


def dealt_in_order(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, text, bucket, extra: bucket b holds the ids between two quantiles, larger ids first; each bucket ends with the document that follows its last one, marked extra.

    Only ids are read to find the quantiles and the following documents (n rows on the driver),
    and the texts are shuffled once. After the last document, the first follows. Null ids are last.
    """
    ids = docs.select("doc_id")
    cuts = np.array(id_cuts(ids, n), np.int64)

    def bucket_of(column: pa.Array) -> np.ndarray:
        return len(cuts) - places(cuts, column)

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, int | None] = {}
        for batch in batches:
            bucket, known = bucket_of(batch.column(0)), np.asarray(batch.column(0).is_valid())
            at, ids_ = np.asarray(batch.column(0).fill_null(0)), np.unique(bucket)
            for b in ids_.tolist():
                mine = at[(bucket == b) & known]
                best[b] = max([x for x in (best.get(b), int(mine.max()) if len(mine) else None) if x is not None], default=None)
        yield pa.RecordBatch.from_arrays([pa.array([*best], pa.int32()), pa.array([*best.values()], pa.int64())], names=["bucket", "top"])

    first = {r[0]: r[1] for r in ids.mapInArrow(tops, "bucket int, top long").groupBy("bucket").agg(F.max("top")).collect()}
    full = sorted(first)
    after: dict[int | None, list[int]] = {}
    for here, following in zip(full, [*full[1:], *full[:1]], strict=True):
        after.setdefault(first[following], []).append(here)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, names = np.array([k for k in after if k is not None], np.int64), ["doc_id", "text", "bucket", "extra"]
        for batch in batches:
            column = batch.column(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bucket_of(column).astype(np.int32)), pa.array(np.zeros(len(column), np.int32))], names=names)
            also = np.isin(np.asarray(column.fill_null(0)), known) & np.asarray(column.is_valid()) | (np.asarray(column.is_null()) if None in after else False)
            for i in np.flatnonzero(also).tolist():
                for b in after[column[i].as_py()]:
                    yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, pa.array([b], pa.int32()), pa.array([1], pa.int32())], names=names)

    dealt = docs.select("doc_id", "text").mapInArrow(deal, "doc_id long, text string, bucket int, extra int").repartitionById(len(cuts) + 1, F.col("bucket"))
    return dealt.sortWithinPartitions("bucket", "extra", F.desc_nulls_last("doc_id"), "text")


def compared(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """The fingerprint of each text, that of its edited text, and how alike they and the next text's are.

    Edited: the last third (rounded down) of the code points gives way to as many, or all, from the start of the next text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = Sampler(samples)
        held, done = None, False  # doc_id, text and samples of the document before; whether its bucket has had its extra row

        for batch in batches:
            out: list[tuple] = []
            for doc_id, text, bucket, extra in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if extra and done:
                    continue  # a tie of the following document
                text = text or ""
                own = draw(terms(text))
                if held is not None and not done:
                    before_id, before, before_own = held
                    n = len(before)
                    edited = before[: n - n // 3] + text[: n // 3]
                    of_edited = draw(terms(edited))
                    sha = hashlib.sha256(edited.encode()).hexdigest()
                    out.append((before_id, n, sha, printed(before_own), printed(of_edited), likeness(before_own, of_edited), likeness(before_own, own)))
                held, done = (doc_id, text, own), bool(extra)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            columns = [*zip(*out, strict=True)] or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in LIKE.split(", ")])

    return dealt_in_order(docs.select("doc_id", "text"), partitions(docs.sparkSession)).mapInArrow(run, LIKE)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: the fingerprints of every document and of its edited text."""
    return compared(documents(spark, sf_dir))
