"""The pipeline and each of its stages, on awkward rows, against the stages' own brute force."""

import corpus
import pytest
from test_neardup import brute as classes_of
from test_quality import brute as measures
from test_tokens import check_packing

import corpus_pipeline


def table():
    clean = [(i, corpus.words(60 + i, i)) for i in range(40)]
    toxic = [(100 + i, corpus.words(60, 500 + i) + " vile nasty horrid") for i in range(20)]
    low = [(200 + i, corpus.words(60, 700 + i) + " qq zz" * 9) for i in range(12)]
    copies = [(300 + i, corpus.words(60 + i, i)) for i in range(10)]
    secret = [(400, corpus.words(50, 900) + " AKIA" + "QX3Z" * 4)]
    texts = clean + toxic + low + copies + secret + [(500, None), (501, ""), (502, "too short")]
    labels = [(i, 1, 0) for i, _ in clean] + [(i, 1, 1) for i, _ in toxic] + [(i, 0, 0) for i, _ in low]
    return texts, labels


def test_run(spark, tmp_path):
    texts, labels = table()
    folder = corpus.written_tables(spark, tmp_path, texts, labels)
    got = corpus_pipeline.run(spark, folder).collect()
    kept = {r["doc_id"] for r in got}
    assert set(range(40)) <= kept and 400 in kept
    assert not kept & ({*range(100, 120)} | {*range(300, 310)} | {500, 501, 502})
    check_packing(got, 4096)


def test_stages_one_by_one(spark, tmp_path):
    texts, labels = table()
    folder = corpus.written_tables(spark, tmp_path, texts, labels)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    one = corpus_pipeline.quality_rules(spark, docs, folder)
    assert {r["doc_id"] for r in one.collect()} == {i for i, t in texts if not measures(t)[5]}
    two = corpus_pipeline.near_duplicates(spark, one, folder)
    left = [(r["doc_id"], r["text"]) for r in one.collect()]
    assert {r["doc_id"] for r in two.collect()} == {c for _, _, c in classes_of(left, 5, 80)}
    three = corpus_pipeline.secret_scan(spark, two, folder)
    found = {r["doc_id"]: r for r in three.collect()}
    assert found[400]["text"].endswith(" [secret]") and found[400]["n_chars"] == len(found[400]["text"]) and found[0]["text"] == dict(texts)[0]


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_awkward_rows(spark, tmp_path, stage):
    folder = corpus.written_tables(spark, tmp_path)
    rows = corpus.documents(spark, corpus.TEXTS + [(None, None), (None, corpus.BASE)])
    for docs in (rows, corpus.clashing(rows), corpus.empty(spark)):
        out = stage(spark, docs, folder)
        n = out.count()
        assert (n == 0) == (docs.count() == 0)
        if stage is not corpus_pipeline.pack:
            assert out.columns == docs.columns


def test_awkward_rows_through_all_stages(spark, tmp_path):
    assert corpus_pipeline.run(spark, corpus.written_tables(spark, tmp_path / "a")).count() > 0
    assert corpus_pipeline.run(spark, corpus.written_tables(spark, tmp_path / "b", [])).count() == 0


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)
