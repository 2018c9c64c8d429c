"""Stateless graphs on streams."""

import pytest

from rivulet.plans.syntax import LanguageError
from rivulet.streaming.stateless import stream


def test_stream(spark, tmp_path):
    spark.range(20).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    script = 's = read[file="replaced"]; f = filter[where="id % 2LL = 0LL"]; c = copy[output="id, id*id AS square"]; s -> f; f -> c;'
    q = stream(script, {"s": source}).format("memory").queryName("squares").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("squares").collect())) == [(i, i * i) for i in range(0, 20, 2)]
    with pytest.raises(LanguageError, match="sort"):
        stream(script.replace("f = filter", "x = sort[key=\"id\"]; f = filter").replace("s -> f", "s -> x; x -> f"), {"s": source})


def test_union_switch_unpivot_and_joins_on_streams(spark, tmp_path):
    """Each operator that runs on streams gives what it gives on the same rows at rest."""
    from rivulet.operators.relation import of_dataframe
    from rivulet.plans.graph import Graph

    spark.range(30).selectExpr("id", "id % 4 AS k", "id * 2 AS x_1", "id * 3 AS x_2").write.parquet(str(tmp_path / "in"))
    spark.range(3).selectExpr("id AS key", "concat('n', id) AS name").write.parquet(str(tmp_path / "side"))
    side = f'side = read[file="{tmp_path}/side", mode="parquet"];'
    scripts = {
        "union": 's = read[file="s"]; c = copy[output="id, k", output="id + 100LL AS id, k"]; u = union_all[]; s -> c; c -> u; c -> u;',
        "switch": 's = read[file="s"]; w = switch[on="CAST(id AS INTEGER)"]; a = copy[output="id, 0 AS way"]; b = copy[output="id, 1 AS way"]; u = union_all[]; s -> w; w -> a; w -> b; a -> u; b -> u;',
        "unpivot": 's = read[file="s"]; c = copy[output="id, x_1, x_2"]; u = unpivot[columnPattern="x_(.)", pivotColumn="p", valueColumn="v"]; s -> c; c -> u;',
        "inner": f's = read[file="s"]; {side} j = hash_join[tableKey="key", probeKey="k", output="id, name"]; side -> j; s -> j;',
        "outer": f's = read[file="s"]; {side} j = hash_right_outer_join[tableKey="key", probeKey="k", output="id, name"]; side -> j; s -> j;',
        "semi": f's = read[file="s"]; {side} j = hash_right_semi_join[tableKey="key", probeKey="k"]; side -> j; s -> j;',
    }
    for name, script in scripts.items():
        source = spark.readStream.schema("id long, k long, x_1 long, x_2 long").parquet(str(tmp_path / "in"))
        q = stream(script, {"s": source}).format("memory").queryName(f"out_{name}").trigger(availableNow=True).start()
        q.awaitTermination(60)
        at_rest = next(iter(Graph.parse(script).run(spark, {"s": of_dataframe(spark.read.parquet(str(tmp_path / "in")))}).values())).visible()
        got = sorted(map(tuple, spark.table(f"out_{name}").collect()), key=repr)
        assert got and got == sorted(map(tuple, at_rest.collect()), key=repr), name
