"""Mixing to target weights with soft membership.

A softmax classifier is trained in numpy on a bounded sample of labelled documents (the
LABELLED with the smallest hash of their id) and gives every document its posteriors over the
domains, from its distinct words, without case and marks, and the beginnings of these words. Each
document d of t_d tokens (words) and posteriors p_d then gets a rate x_d >= 0, so that the
expected totals, sum of x_d t_d p_d, match the targets by least squares, rates staying near 1
otherwise:

    1/2 sum over domains (sum x_d t_d p_d - target)^2 / (M size) + 1/2 sum (t_d / M) (p_d ridge) (x_d - 1)^2.

A domain's size is its tokens at rate 1, or its target where that is more, so that a domain
counts by its relative error, however rare it is. The ridge is small and only breaks ties
between documents; it is 0 for a domain whose target is 0, so that nothing holds its sure members
back from rate 0. Rates only scale what the posteriors say, so the totals that can be reached are
the cone of all p_d: a share of 0, or one below what each document has, is out of reach, and the
fit comes as near as it can. outcome() tells the expected shares beside the targets.

Projected gradient steps with momentum, in the inner product weighted by t_d / M, need only the
residual, a number for each domain, which each step sums over all documents; the rates are
functions of the residuals so far and are worked out anew in each task, so no state of
documents is kept or sent.

Null and empty texts have no tokens and the posteriors of the intercepts. Rows with equal
doc_id are judged each for itself (the one of the least text hash stands for a labelled id);
labels of a doc_id in more than one row count as toxic if any is, of quality if all are. Without
labelled documents the posteriors are equal, and an empty table gives no rows. Other columns
pass through apply_rates() untouched.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.llm.common import discard, documents, free, written

DOMAINS = ("clean", "low", "toxic")
#: Shares of the tokens that the mix is to have.
WEIGHTS = {"clean": 0.95, "low": 0.05, "toxic": 0.0}
LABELLED = 3000
SIGNIFICANT, STRONGEST = 6.0, 8
BUCKETS = 1 << 16
BEGINNINGS = (4, 6)
RIDGE = 0.005
STEPS, TOLERANCE = 80, 1e-5
MARKS = b"#*$%&|<>!"
EDGES = b".,!?:;\"'()[]{}*#$%&|<>"
N_DENSE = 5


def features(text: str | None) -> tuple[np.ndarray, list[float], int]:
    """Buckets of the distinct words without case and marks and of their first BEGINNINGS bytes, dense measures, number of words."""
    raw = (text or "").encode()
    ws = raw.split()
    n = len(ws)
    distinct = {w.strip(EDGES) for w in raw.lower().split()}
    terms = distinct.union(*({w[:k] + b"-" for w in distinct if len(w) > k} for k in BEGINNINGS)) - {b""}
    buckets = np.unique(np.fromiter((zlib.crc32(w) % BUCKETS for w in terms), np.int64, len(terms)))
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    marks = len(raw) - len(raw.translate(None, MARKS))
    m = max(n, 1)
    return buckets, [upper / max(len(raw), 1) * 5, min(marks / m, 2.0), len(distinct) / m, min(len(raw) / m / 10, 2.0), min(np.log1p(n) / 10, 2.0)], n


class Classifier:
    """Softmax regression on a few measures: for each domain, the sum of the document's STRONGEST log odds of buckets that tell the domain from the rest (beyond SIGNIFICANT standard errors), and the dense measures."""

    def __init__(self, odds: np.ndarray, weights: np.ndarray):
        self.odds, self.weights = odds, weights

    @classmethod
    def train(cls, rows: list[tuple[int, np.ndarray, list[float]]], steps: int = 1500, rate: float = 0.05, decay: float = 1e-4) -> Classifier:
        """rows: (domain, buckets, dense). Adam on the mean log loss."""
        k = len(DOMAINS)
        odds, weights = np.zeros((BUCKETS, k), np.float32), np.zeros((k + N_DENSE + 1, k))
        if not rows:
            return cls(odds, weights)
        y, size = np.array([r[0] for r in rows]), np.array([len(r[1]) for r in rows])
        flat = np.concatenate([r[1] for r in rows])
        with_ = np.bincount(np.repeat(y, size) * BUCKETS + flat, minlength=k * BUCKETS).reshape(k, BUCKETS).astype(float)
        n = np.bincount(y, minlength=k).astype(float)
        for d in range(k):
            if 0 < n[d] < n.sum():
                a, b = with_[d], with_.sum(axis=0) - with_[d]
                p, q, both = a / n[d], b / (n.sum() - n[d]), (a + b) / n.sum()
                error = np.sqrt(both * (1 - both) * (1 / n[d] + 1 / (n.sum() - n[d]))) + 1e-12
                ratio = np.log((a + 0.5) / (n[d] + 1)) - np.log((b + 0.5) / (n.sum() - n[d] + 1))
                odds[:, d] = np.where(np.abs(p - q) > SIGNIFICANT * error, ratio, 0)
        x = np.array([cls.measures(odds, r[1], r[2]) for r in rows])
        true = np.eye(k)[y]
        m, v = np.zeros_like(weights), np.zeros_like(weights)
        for step in range(1, steps + 1):
            z = x @ weights
            z = np.exp(z - z.max(axis=1, keepdims=True))
            g = x.T @ (z / z.sum(axis=1, keepdims=True) - true) / len(rows) + decay * weights
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            weights -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return cls(odds, weights)

    @staticmethod
    def measures(odds: np.ndarray, buckets: np.ndarray, dense: list[float]) -> np.ndarray:
        own = odds[buckets]
        top = np.partition(own, len(own) - STRONGEST, axis=0)[-STRONGEST:] if len(own) > STRONGEST else own
        return np.concatenate([top.sum(axis=0, dtype=np.float64) / STRONGEST, dense, [1.0]])

    def posteriors(self, buckets: np.ndarray, dense: list[float]) -> np.ndarray:
        z = self.measures(self.odds, buckets, dense) @ self.weights
        z = np.exp(z - z.max())
        return z / z.sum()


def train(docs: DataFrame, labels: DataFrame, n: int = LABELLED) -> Classifier:
    clear = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0).alias("domain")
    here = clear.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = here.select("doc_id", domain).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [features(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([g[0].astype("<i4").tobytes() for g in got], pa.binary()), pa.array([g[1] for g in got], pa.list_(pa.float64()))], names=["doc_id", "domain", "buckets", "dense"])

    # one row for each chosen id, however many rows have it: n rows at most reach the driver
    mine = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    one = mine.groupBy("doc_id", "domain").agg(F.min(F.struct(F.xxhash64("text").alias("by"), "text")).alias("least")).select("doc_id", "domain", "least.text")
    found = sorted(one.mapInArrow(run, "doc_id long, domain int, buckets binary, dense array<double>").collect(), key=lambda r: r["doc_id"])
    return Classifier.train([(r["domain"], np.frombuffer(r["buckets"], "<i4").astype(np.int64), r["dense"]) for r in found])


def memberships(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, a hash of the text, n_tokens and the posteriors of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [features(x.as_py()) for x in batch.column(1)]
            p = np.array([model.posteriors(g[0], g[1]) for g in got]).reshape(-1, len(DOMAINS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[2] for g in got], pa.int64()), *(pa.array(p[:, i], pa.float64()) for i in range(len(DOMAINS)))], names=["doc_id", "n_tokens", *DOMAINS])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, " + ", ".join(f"{d} double" for d in DOMAINS))


def replayed(p: np.ndarray, history: list[np.ndarray], ridge: float | np.ndarray = RIDGE) -> tuple[np.ndarray, np.ndarray]:
    """The rates and the points where the next gradient is taken, after the steps whose residuals are given. ridge: one for all domains, or each one's."""
    x = y = np.ones(len(p))
    t, eta = 1.0, 1 / (1 + np.max(ridge))
    pull = p @ np.broadcast_to(ridge, len(DOMAINS))
    for residual in history:
        new = np.maximum(0.0, y - eta * (p @ residual + pull * (y - 1)))
        following = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / following * (new - x)
        x, t = new, following
    return x, y


def columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    get = lambda name: np.asarray(batch.column(batch.schema.get_field_index(name)), np.float64)
    return get("n_tokens"), np.stack([get(d) for d in DOMAINS], 1)


def ridges(weights: dict[str, float], ridge: float = RIDGE) -> np.ndarray:
    """The ridge of each domain: none where the target is 0."""
    return np.array([ridge if weights.get(d, 0.0) else 0.0 for d in DOMAINS])


def totals(members: DataFrame, rates: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The expected tokens of each domain at rates(posteriors)."""
    kind = ", ".join(f"{d} double" for d in DOMAINS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(len(DOMAINS))
        for batch in batches:
            t, p = columns(batch)
            out += (rates(p) * t) @ p
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in out], names=[*DOMAINS])

    got = members.mapInArrow(run, kind).agg(*[F.sum(d) for d in DOMAINS]).first()
    return np.array([v or 0.0 for v in got])


def wanted_totals(own: np.ndarray, weights: dict[str, float], budget: str | None) -> np.ndarray:
    """The targets. budget: the domain whose tokens at rate 1 set the size of the mix; None: all tokens as they are."""
    share = np.array([weights.get(d, 0.0) for d in DOMAINS])
    share = share / share.sum()
    at = DOMAINS.index(budget) if budget else None
    return share * (own.sum() if at is None or not share[at] else own[at] / share[at])


def solve(members: DataFrame, weights: dict[str, float], budget: str | None = "clean", ridge: float | np.ndarray = RIDGE, relative: bool = False) -> list[np.ndarray]:
    """The residuals of all steps. relative: residuals by each domain's size, else by the size of all."""
    own = totals(members, lambda p: np.ones(len(p)))
    m = own.sum()
    if not m:
        return []
    target = wanted_totals(own, weights, budget)
    size = np.maximum(np.maximum(own, target), np.finfo(float).tiny) if relative else m
    history = [(own - target) / size]
    while len(history) < STEPS:
        history.append((totals(members, lambda p: replayed(p, history, ridge)[1]) - target) / size)
        if np.abs(history[-1] - history[-2]).max() < TOLERANCE:
            break
    return history


def outcome(members: DataFrame, weights: dict[str, float], history: list[np.ndarray], budget: str | None = "clean", ridge: float | np.ndarray = RIDGE) -> dict[str, tuple[float, float]]:
    """The target and the expected share of the tokens of each domain at the fitted rates. They differ where the targets are out of reach."""
    target = wanted_totals(totals(members, lambda p: np.ones(len(p))), weights, budget)
    got = totals(members, lambda p: replayed(p, history, ridge)[0])
    share = lambda x: (x / max(x.sum(), np.finfo(float).tiny)).tolist()
    return dict(zip(DOMAINS, zip(share(target), share(got), strict=True), strict=True))


def copies(rate: Column) -> Column:
    """The rate, rounded up or down by a hash of doc_id, whole in the mean."""
    unit = (F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) + 0.5) / (1 << 30)
    return F.floor(rate + unit)


def rated(members: DataFrame, history: list[np.ndarray], ridge: float | np.ndarray = RIDGE) -> DataFrame:
    """members with `rate` and `copies`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = replayed(columns(batch)[1], history, ridge)[0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(x)], names=[*batch.schema.names, "rate"])

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in members.schema.fields)
    return members.mapInArrow(run, f"{kind}, rate double").withColumn("copies", copies(F.col("rate")).cast("long"))


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, budget: str | None = "clean") -> DataFrame:
    """doc_id, n_tokens, posteriors, rate and copies of every document."""
    members = written(memberships(docs, train(docs, labels)), "members")
    wanted = weights or WEIGHTS
    ridge = ridges(wanted)
    return rated(members, solve(members, wanted, budget, ridge, True), ridge)


def apply_rates(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """docs' own rows, each as often as `copies` says. Texts go through the classifier where they lie and are not shuffled."""
    model = train(docs, labels)
    wanted = weights or WEIGHTS
    held = ridges(wanted)
    members = written(memberships(docs, model).drop("doc_id"), "members")
    history = solve(members, wanted, ridge=held, relative=True)
    discard(members)
    at, rate = docs.columns.index("text"), free("__rate", docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [features(x.as_py()) for x in batch.column(at)]
            p = np.array([model.posteriors(g[0], g[1]) for g in got]).reshape(-1, len(DOMAINS))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(replayed(p, history, held)[0])], names=[*batch.schema.names, rate])

    rows = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(rate, T.DoubleType())]))
    again = copies(F.col(rate)).cast("int")
    return rows.withColumn(rate, F.explode(F.array_repeat(F.lit(1.0), again))).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: every document's posteriors, rate and copies."""
    return mix(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
