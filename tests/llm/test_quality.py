import re

import corpus
import duckdb
import pytest
from pyspark.sql import functions as F

from rivulet.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    ws = WORD.findall(text)
    at = {}
    for i in range(len(ws) - 4):
        at.setdefault(tuple(ws[i : i + 5]), []).append(i)
    covered = {i + j for places in at.values() if len(places) > 1 for i in places for j in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(ws) < 10 or 100 * len(covered) > 20 * len(ws)
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def test_query_against_brute_force_and_sql(spark, tmp_path):
    folder = corpus.written_tables(spark, tmp_path)
    got = sorted(tuple(r) for r in quality.query(spark, folder).collect())
    want = sorted((i, *brute(t)) for i, t in corpus.TEXTS)
    assert [r[:7] for r in got] == [(r[0], r[1], r[2], r[3], r[4], r[5], r[6]) for r in want]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{folder}/documents.parquet/*.parquet' WHERE doc_id <> 17")  # the SQL joins by doc_id
    assert sorted(con.sql(quality.SQL).fetchall()) == [r for r in got if r[0] != 17]
    kept = {r[0]: r[7] for r in got}
    assert kept[0] and kept[3] and not kept[15] and not kept[16] and not kept[12] and not kept[4]


def test_overlapping_repeats(spark):
    for text in ("a " * 30, "a b c d e f a b c d e g a b c d e", "a b c d e a b c d e f g h i a b c d", "x y z " * 7):
        df = spark.createDataFrame([(text,)], "text string").select(quality.n_repeat_words(quality.words(F.col("text"))))
        assert df.first()[0] == brute(text)[4]


def test_any_order_gives_the_same_rows(spark, monkeypatch):
    docs = corpus.clashing(corpus.documents(spark))
    rules = quality.RULES + quality.MORE_RULES
    want = sorted(r["doc_id"] for r in quality.keep(docs).collect())
    for order in (rules, rules[::-1]):
        monkeypatch.setattr(quality, "cascade_order", lambda d, r, order=order: list(order))
        got = quality.keep(docs)
        assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == want
    assert want == sorted(i for i, t in corpus.TEXTS if i not in (4, 5, 6, 7, 8, 9, 10, 12, 15, 16, 20))


def test_measured_order(spark):
    docs = corpus.documents(spark, [(i, "short text" if i % 2 else corpus.words(300, i)) for i in range(60)])
    order = quality.cascade_order(docs, quality.RULES + quality.MORE_RULES)
    assert order[0].name == "few_words" and len(order) == 6


def test_the_order_is_steady(spark):
    docs = corpus.documents(spark, [(i, "short text" if i % 2 else corpus.words(300, i) + (" # $" * 20 if i % 8 == 0 else "")) for i in range(200)])
    orders = {tuple(r.name for r in quality.cascade_order(docs, quality.RULES + quality.MORE_RULES)[:2]) for _ in range(5)}
    assert len(orders) == 1


def test_the_sample_is_bounded_and_reads_few_files(spark, tmp_path):
    """Whatever the ids: here all are null or equal."""
    corpus.documents(spark, [(None if i % 2 else 5, f"text {i} " + corpus.words(5, i)) for i in range(3000)], 20).write.parquet(f"{tmp_path}/many")
    docs = spark.read.parquet(f"{tmp_path}/many").select("doc_id", "text")
    some = quality.sample(docs, 100)
    assert 0 < some.count() <= 100
    assert len(some.inputFiles()) == quality.SAMPLE_FILES or "file_path" in some._jdf.queryExecution().optimizedPlan().toString()
    scan = docs.where(F.col("_metadata.file_path").isin(sorted(docs.inputFiles())[:8])).select("text")
    assert scan.rdd.getNumPartitions() <= 8
    plain = corpus.documents(spark, [(None, f"t {i}") for i in range(500)])
    assert 0 < quality.sample(plain, 100).count() <= 100


def test_what_base_rules_reject_is_not_put_to_others(spark, monkeypatch, tmp_path):
    fails = quality.Rule("fails", lambda text, ws: F.raise_error(F.lit("asked")).cast("boolean"))
    monkeypatch.setattr(quality, "cascade_order", lambda d, r: [fails])
    folder = corpus.written_tables(spark, tmp_path, [(1, "few words"), (2, None), (3, "a b c d e " * 9)])
    assert [r["kept"] for r in quality.query(spark, folder).collect()] == [False] * 3


def test_empty_table(spark):
    assert quality.keep(corpus.empty(spark)).count() == 0


def test_no_python_runs(spark, tmp_path):
    plan = quality.query(spark, corpus.written_tables(spark, tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("text", [None, "", " \n\t"])
def test_no_words_fail(spark, text):
    assert quality.keep(corpus.documents(spark, [(1, text)])).count() == 0
