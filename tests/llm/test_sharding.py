import re
import zlib

import corpus

from rivulet.llm import sharding


def test_query(spark, tmp_path):
    texts = corpus.TEXTS + [(100 + i, corpus.words(1 + i % 90, i)) for i in range(900)]
    got = sharding.query(spark, corpus.written_tables(spark, tmp_path, texts)).collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sorted((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts)
    places = {}
    for r in got:
        places.setdefault(r["shard"], []).append(r)
    assert set(places) == set(range(24)) and all(sorted(r["slot"] for r in rows) == [*range(len(rows))] for rows in places.values())
    loads = sorted(sum(r["size"] for r in rows) for rows in places.values())
    assert loads[-3] - loads[0] < 0.02 * loads[0]  # the fullest two have a text each that is larger than a shard
    assert {(r["law"], r["grown_shard"]) for r in got} == {("bytes", None)}


def test_versions_are_kept_and_edits_are_few(spark, tmp_path):
    docs = corpus.documents(spark, [(i, corpus.words(20, i)) for i in range(3000)])
    path, last = sharding.build_map(docs, 5, 256, str(tmp_path / "map"))
    maps = {v: {r["vslot"]: r["shard"] for r in spark.read.parquet(path).where(f"version = {v}").collect()} for v in (0, last)}
    assert maps[0] == {s: s % 5 for s in range(256)} and len(maps[1]) == 256
    assert 0 < sum(maps[0][s] != maps[1][s] for s in range(256)) < 60
    first = {r["doc_id"]: r["vslot"] for r in sharding.shard(docs, path, 0, 256).collect()}
    assert first == {r["doc_id"]: r["vslot"] for r in sharding.shard(docs, path, 1, 256).collect()}


def test_rebalanced_never_worsens():
    sizes = [7, 7, 7, 100, 1, 1, 0, 3, 50, 49]
    got = sharding.rebalanced([s % 2 for s in range(10)], sizes, 2)
    loads = [sum(z for z, s in zip(sizes, got, strict=True) if s == k) for k in (0, 1)]
    assert abs(loads[0] - loads[1]) <= 1 and sharding.rebalanced([], [], 3) == []


def test_nulls_repeats_empty(spark, tmp_path):
    docs = corpus.clashing(corpus.documents(spark, [(None, None), (None, "x"), (1, "y"), (1, "y")]))
    got = sharding.shard(docs, *sharding.build_map(docs, 3)).collect()
    assert len(got) == 4 and sorted(r["size"] for r in got) == [8, 9, 9, 9]
    none = corpus.empty(spark)
    path, version = sharding.build_map(none, 3)
    assert sharding.shard(none, path, version).count() == 0 and spark.read.parquet(path).where("version = 0").count() == sharding.N_SLOTS


def test_no_python_runs(spark, tmp_path):
    plan = sharding.query(spark, corpus.written_tables(spark, tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
