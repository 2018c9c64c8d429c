import corpus
import numpy as np
import pytest
from pyspark.sql import functions as F

from rivulet.llm import mixing


def labelled(n=160):
    texts, labels = [], []
    for i in range(n):
        t = corpus.words(60, i)
        kind = i % 4
        if kind == 2:
            t = t.upper() + " !! !! ##"
        if kind == 3:
            t += " vile nasty horrid"
        texts.append((i, t))
        labels.append((i, 0 if kind == 2 else 1, 1 if kind == 3 else 0))
    return texts, labels


def test_held_out_accuracy_and_targets(spark):
    texts, labels = labelled(240)
    docs = corpus.clashing(corpus.documents(spark, texts)).drop("clean", "rate", "n")
    known = spark.createDataFrame([x for x in labels if x[0] % 3], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in mixing.mix(docs, known).collect()}
    kinds = ("clean", "clean", "low", "toxic")
    right = [max(mixing.DOMAINS, key=lambda d, r=got[i]: r[d]) == kinds[i % 4] for i in range(0, 240, 3)]
    assert np.mean(right) > 0.95 and len(got) == 240
    tokens = {d: sum(r["n_tokens"] * r["rate"] * r[d] for r in got.values()) for d in mixing.DOMAINS}
    share = {d: v / sum(tokens.values()) for d, v in tokens.items()}
    assert abs(share["clean"] - 0.95) < 0.03 and share["toxic"] < 0.02
    assert all(got[i]["copies"] == 1 for i in range(240) if i % 4 < 2) and sum(got[i]["copies"] for i in range(240) if i % 4 == 3) == 0


def test_rates_solve_the_least_squares_problem(spark):
    """Against projected gradient on the whole problem in one place."""
    draw = np.random.default_rng(5)
    p = draw.dirichlet((1, 1, 1), 50)
    t = draw.integers(1, 100, 50)
    members = spark.createDataFrame([(int(n), *map(float, q)) for n, q in zip(t, p, strict=True)], "n_tokens long, " + ", ".join(f"{d} double" for d in mixing.DOMAINS))
    history = mixing.solve(members, {"clean": 0.6, "low": 0.3, "toxic": 0.1}, None)
    x = mixing.replayed(p, history)[0]
    target, w = np.array([0.6, 0.3, 0.1]), t / t.sum()
    y = np.ones(50)
    for _ in range(20000):
        y = np.maximum(0, y - 0.5 * (p @ ((y * w) @ p - target) + mixing.RIDGE * (y - 1)))
    assert np.abs(x - y).max() < 1e-2 and (x >= 0).all()


@pytest.mark.parametrize(("weights", "reached"), [({"clean": 0.88, "low": 0.07, "toxic": 0.05}, True), ({"clean": 0.8, "low": 0.15, "toxic": 0.05}, True), ({"clean": 0.0, "low": 0.0, "toxic": 1.0}, False), (mixing.WEIGHTS, False)])
def test_expected_shares_are_the_targets_where_these_can_be_reached(spark, weights, reached):
    """On a whole table: within half a point, or outcome() tells how far off. With few labels no document is surely not toxic, so a share of 0 is out of reach."""
    d = "/root/testdata/sf0.01"
    docs, labels = mixing.documents(spark, d), spark.read.parquet(f"{d}/labels.parquet")
    members = mixing.written(mixing.memberships(docs, mixing.train(docs, labels)), "members")
    held = mixing.ridges(weights)
    budget = "clean" if weights["clean"] else None
    got = mixing.outcome(members, weights, mixing.solve(members, weights, budget, held, True), budget, held)
    off = {k: abs(target - share) for k, (target, share) in got.items()}
    assert all(abs(got[k][0] - weights[k]) < 1e-9 for k in weights)
    assert (max(off.values()) < 0.005) == reached
    least = np.array(members.agg(*[F.min(F.col(k)) for k in mixing.DOMAINS]).first(), float)
    assert all(got[k][1] >= x - 1e-9 for k, x in zip(mixing.DOMAINS, least, strict=True))


def test_a_labelled_id_of_many_rows_sends_one(spark):
    docs = spark.range(4000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 3).alias("text"))
    seen = []
    train = mixing.Classifier.train
    try:
        mixing.Classifier.train = classmethod(lambda cls, rows, **kw: (seen.append(len(rows)), train(rows, **kw))[1])
        mixing.train(docs, spark.createDataFrame([(7, 1, 0)], "doc_id long, quality int, toxic int"))
    finally:
        mixing.Classifier.train = train
    assert seen == [1]


def test_apply_rates(spark):
    texts, labels = labelled(120)
    docs = corpus.documents(spark, [*texts, (None, None), (500, ""), (1, texts[1][1])])
    out = mixing.apply_rates(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert out.columns == docs.columns
    ids = [r["doc_id"] for r in out.collect()]
    assert {i for i in range(120) if i % 4 < 2} <= set(ids) and not {i for i in range(120) if i % 4 == 3} & set(ids) and ids.count(1) == 2


def test_no_labels_and_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = mixing.mix(corpus.documents(spark), none).select("clean", "low", "toxic").distinct().collect()
    assert len(got) == 1 and abs(got[0]["clean"] - 1 / 3) < 1e-9
    assert mixing.mix(corpus.empty(spark), none).count() == 0 and mixing.apply_rates(corpus.empty(spark), none).count() == 0
    odd = spark.createDataFrame([(None, 1, 0), (3, None, None), (3, 0, 1), (999, 1, 1)], "doc_id long, quality int, toxic int")
    assert mixing.mix(corpus.documents(spark), odd).count() == len(corpus.TEXTS)


def test_copies_are_whole_in_the_mean(spark):
    members = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit(1).cast("long").alias("n_tokens"), *[F.lit(1 / 3).alias(d) for d in mixing.DOMAINS])
    history = [np.full(3, 0.6 * (1 + mixing.RIDGE))]
    r = mixing.rated(members, history).agg(F.avg("rate"), F.avg("copies")).first()
    assert abs(r[0] - 0.4) < 1e-9 and abs(r[1] - 0.4) < 0.02


@pytest.mark.parametrize("share", [0.003, 0.01, 0.03])
def test_rare_toxic_documents_go(spark, share):
    """Posteriors of 0.97 and 0.99 and a low domain of 10 percent: a target of 0 takes sure members to 0 however rare they are, and leaves clean ones at 1."""
    n = 20000
    kind = F.when(F.col("id") < n * share, 2).when(F.col("id") < n * (share + 0.1), 1).otherwise(0)
    posteriors = {"clean": (0.99, 0.02, 0.02), "low": (0.007, 0.97, 0.01), "toxic": (0.003, 0.01, 0.97)}
    at = lambda d: F.element_at(F.array(*map(F.lit, posteriors[d])), F.col("kind") + 1).alias(d)
    members = spark.range(n).withColumn("kind", kind).select(F.col("id").alias("doc_id"), F.lit(100).cast("long").alias("n_tokens"), "kind", *map(at, mixing.DOMAINS))
    for ridge in (mixing.RIDGE, 0.02):
        held = mixing.ridges(mixing.WEIGHTS, ridge)
        got = mixing.rated(members, mixing.solve(members, mixing.WEIGHTS, ridge=held, relative=True), held)
        mean = {r["kind"]: r for r in got.groupBy("kind").agg(F.avg("rate").alias("rate"), F.avg("copies").alias("copies")).collect()}
        assert mean[2]["rate"] < 0.01 and mean[2]["copies"] < 0.01
        assert abs(mean[0]["rate"] - 1) < 0.03 and abs(mean[1]["rate"] - 0.45) < 0.06
        assert all(abs(mean[k]["rate"] - mean[k]["copies"]) < 0.03 for k in mean)


def test_rates_near_whole_numbers_are_whole_in_the_mean(spark):
    members = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit(1).cast("long").alias("n_tokens"), *[F.lit(1 / 3).alias(d) for d in mixing.DOMAINS])
    for rate in (0.1, 0.9):
        r = mixing.rated(members, [np.full(3, (1 - rate) * (1 + mixing.RIDGE))]).agg(F.avg("copies")).first()
        assert abs(r[0] - rate) < 0.02
