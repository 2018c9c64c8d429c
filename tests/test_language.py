"""The expression language, row by row of its tables, and the graphs' checks."""

import datetime as dt
from decimal import Decimal

import pytest

from rivulet.functions.types import parse_format, print_format
from rivulet.operators.registry import REGISTRY, register_operator
from rivulet.plans.graph import Graph, MapReduceJob, run
from rivulet.plans.syntax import LanguageError, Parser


def value(spark, text, row="RECORDCOUNT AS r"):
    """The value of an expression on one generated row."""
    return run(spark, f'g = generate[output="{row}", numRecords=1]; c = copy[output="{text} AS x"]; g -> c;').first()["x"]


NULL = "CAST(NULL AS INTEGER)"


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("1 + 2*3", 7), ("(1 + 2)*3", 9), ("-7/2", -3), ("7 % -2", 1), ("-7 % 2", -1), ("2 - 3 - 4", -5), ("1 | 2 & 3", 3), ("6 ^ 3", 5), ("~5", -6), ("8 | 1 = 1", 9),
        ("99999999999LL + 1", 100000000000), ("1.5 + 1", Decimal("2.5")), ("1.5e0 * 2", 3.0), ("3f", 3.0), (".5", Decimal("0.5")), ("1 < 2", 1), ("1 <> 1", 0), ("TRUE AND 0 = 1", 0),
        (f"{NULL} + 1", None), (f"{NULL} = 1", None), (f"{NULL} IS NULL", 1), ("1 IS NOT NULL", 1),
        (f"{NULL} = 1 AND 1 = 1", 0), (f"1 = 1 AND {NULL} = 1", None), (f"{NULL} = 1 OR 1 = 2", 0), (f"1 = 2 OR {NULL} = 1", None), (f"NOT ({NULL} = 1)", None), ("1 = 2 AND 1/0 = 1", 0), ("1 = 1 OR 1/0 = 1", 1),
        ("CASE WHEN 1 = 2 THEN 3 END", None), ("CASE WHEN 1 = 2 THEN 3 WHEN 2 = 2 THEN 4 ELSE 5 END", 4), (f"CASE WHEN {NULL} = 1 THEN 3 ELSE 6LL END", 6), ("2 > 1 ? 'a' : 'b'", "a"),
        ("'a' + 'b'", "ab"), (r"'it\\'s'".replace("\\\\", "\\"), "it's"), ("'abc' RLIKE 'b'", 0), ("'abc' RLIKE 'a.c'", 1), ("'ABC' RLIKE '(?i)abc'", 1),
        ("[1, 2, 3][1]", None), ("CAST('12ab' AS INTEGER)", 12), ("CAST('x' AS INTEGER)", 0), ("CAST(2.5 AS INTEGER)", 2), ("CAST(3.5 AS INTEGER)", 4), ("CAST(-2.9e0 AS INTEGER)", -2), ("CAST(4294967297LL AS INTEGER)", 1),
        ("CAST(7 AS VARCHAR)", "7"), ("CAST('ab' AS CHAR(4))", "ab  "), ("CAST('abcdef' AS CHAR(4))", "abcd"), ("CAST(1.5e0 AS VARCHAR)", "1.5"), ("CAST(100.0e0 AS VARCHAR)", "100"), ("CAST('1.25' AS DECIMAL)", Decimal("1.25")),
        ("CAST('2011-02-17' AS DATE)", dt.date(2011, 2, 17)), ("CAST('2011-02-17 15:38:33' AS DATETIME)", dt.datetime(2011, 2, 17, 15, 38, 33)), ("CAST(CAST('2011-02-17' AS DATE) AS INTEGER)", 20110217),
        ("CAST('2011-02-28' AS DATE) + INTERVAL 1 MONTH", dt.date(2011, 3, 31)), ("CAST('2011-01-30' AS DATE) + INTERVAL 1 MONTH", dt.date(2011, 2, 28)), ("INTERVAL 1 DAY + CAST('2011-02-28' AS DATE)", dt.date(2011, 3, 1)),
        ("CAST('2011-02-28' AS DATE) - INTERVAL 2 HOUR", dt.datetime(2011, 2, 27, 22)), ("CAST('2011-02-28 01:00:00' AS DATETIME) + INTERVAL 1 YEAR", dt.datetime(2012, 2, 29, 1)), ("INTERVAL 3 MINUTE", 3),
        ("length('häh')", 4), ("substr('abcdef', 1, 2)", "bc"), ("substr('abcdef', 2, -1)", "cdef"), ("substr('abc', 9, 2)", ""), ("trim(' \t a ')", "a"), ("ltrim(' a ')", "a "), ("rtrim(' a ')", " a"),
        ("ceil(1.2e0)", 2.0), ("floor(-1.2e0)", -2.0), ("sqrt(9.0e0)", 3.0), ("round(2.345, 2)", Decimal("2.34")), ("log(0.0e0)", float("-inf")), ("exp(0.0e0)", 1.0),
        ("julian_day(CAST('2011-02-17' AS DATE))", 2455610), ("dayofweek(CAST('2011-02-17' AS DATE))", 5), ("datediff(CAST('2011-02-17' AS DATE), CAST('2011-02-10' AS DATE))", 7), ("last_day(CAST('2012-02-17' AS DATE))", dt.date(2012, 2, 29)),
        ("least(3, 1, 2)", 1), (f"least({NULL}, 4)", 4), (f"greatest(4, {NULL})", None), (f"ISNULL({NULL}, 5)", 5), ("ifnull(3, 5)", 3), ("unix_timestamp(CAST('2011-02-17 15:38:33' AS DATETIME))", 1297975113),
        ("$(0)", 1 << 30), ("$(5LL)", 1 << 30), ("#(1, 'a') = #(1, 'a')", 1), ("/* no */ 1 // end\n", 1),
    ],
)
def test_expression(spark, text, expected):
    if text == "[1, 2, 3][1]":  # only names are indexed
        with pytest.raises(LanguageError):
            value(spark, text)
        return
    got = value(spark, text)
    assert got == expected and (expected is None or type(got) is type(expected))


@pytest.mark.parametrize(
    "text",
    ["1 LIKE 2", "0x1F", "N'a'", "CASE 1 WHEN 1 THEN 2 END", "nosuch(1)", "r + 'a'", "1.5 % 2", "SUM(r)", "unknown", "NULL", "CAST(1 AS NVARCHAR)", "CAST(1 AS CHAR)", "'2011' = 2011", "[r, NULL]", "md5(r)", "1 = 2 = 3"],
)
def test_rejected(spark, text):
    with pytest.raises(LanguageError):
        value(spark, text)


@pytest.mark.parametrize(
    "script",
    [
        "a = nosuch[];", "a = filter[];", "a = generate[output=\"RECORDCOUNT AS r\", rows=3];", "a -> b;", "a = generate[output=\"RECORDCOUNT AS r\"]; a = devNull[];",
        "a = filter[]; b = filter[]; a -> b; b -> a;", "a = generate[output=\"1 AS length\"];", "a = generate[output=\"1 AS x, 2 AS x\"];", "a = generate[output=\"1 + 1\"];",
        "a = generate[output=\"RECORDCOUNT AS r\"]; b = hash_group_by[key=\"r\", output=\"r, r + 1 AS s, SUM(SUM(r)) AS t\"]; a -> b;",
        "a = generate[output=\"RECORDCOUNT AS r, RECORDCOUNT AS q\"]; b = hash_group_by[key=\"r\", output=\"r, q\"]; a -> b;",
        "a = generate[output=\"RECORDCOUNT AS r\"]; b = generate[output=\"RECORDCOUNT AS r\"]; j = hash_join[tableKey=\"r\", probeKey=\"r\", output=\"r\"]; a -> j; b -> j;",
        "a = generate[output=\"RECORDCOUNT AS r\"]; b = generate[output=\"'x' AS r\"]; u = union_all[]; a -> u; b -> u;",
        "a = generate[output=\"RECORDCOUNT AS r\"]; b = sort_group_by[key=\"r\", initialize=\"0 AS n\"]; a -> b;",
        "a = generate[output=\"RECORDCOUNT AS r\"]; b = sort_group_by[key=\"r\", initialize=\"0 AS n\", update=\"SET n = 'x'\"]; a -> b;",
        "a = generate[output=\"RECORDCOUNT AS r\"]; b = sort_group_by[key=\"r\", initialize=\"0 AS n\", update=\"PRINT n\"]; a -> b;",
    ],
)
def test_bad_graph(spark, script):
    with pytest.raises(LanguageError):
        run(spark, script)


def test_formats():
    text = "a INTEGER,b BIGINT NULL,c DECIMAL,d DOUBLE PRECISION,e VARCHAR,f CHAR(8) NULL,g DATETIME,h DATE"
    assert print_format(parse_format(text.lower().replace("integer", "Integer"))) == text.lower().replace("integer", "INTEGER").replace("bigint null", "BIGINT NULL").replace("decimal", "DECIMAL").replace(
        "double precision", "DOUBLE PRECISION"
    ).replace("varchar", "VARCHAR").replace("char(8) null", "CHAR(8) NULL").replace("datetime", "DATETIME").replace("h date", "h DATE")
    assert [f.type.nullable for f in parse_format("a INTEGER NOT NULL, b DATE NULL")] == [False, True]


def test_running_total_and_fold_on_the_same_rows(spark):
    rows = 'g = generate[output="RECORDCOUNT/3 AS a, RECORDCOUNT*RECORDCOUNT AS b, 2*RECORDCOUNT AS c", numRecords=7];'
    a = run(spark, rows + 'r = sort_group_by[key="a", output="a, b, SUM(b) AS s, MIN(c) AS m", runningtotal="true"]; g -> r;').collect()
    assert [tuple(x) for x in a] == [(0, 0, 0, 0), (0, 1, 1, 0), (0, 4, 5, 0), (1, 9, 9, 6), (1, 16, 25, 6), (1, 25, 50, 6), (2, 36, 36, 12)]
    b = run(spark, rows + 'r = sort_group_by[key="a", initialize="CAST(0 AS BIGINT) AS s", update="SET s = s + b", runningtotal="true"]; g -> r;').collect()
    assert sorted(map(tuple, b)) == sorted((x["a"], x["s"]) for x in a)


def test_fold_without_rows_keys_or_order(spark):
    empty = 'g = generate[output="RECORDCOUNT AS r", numRecords=5]; f = filter[where="r > 9LL"]; k = sort_group_by[initialize="3 AS n", update="SET n = n + 1"]; g -> f; f -> k;'
    assert [tuple(x) for x in run(spark, empty).collect()] == [(3,)]
    unordered = 'g = generate[output="RECORDCOUNT AS r", numRecords=5]; a = hash_group_by[key="r", output="r"]; k = sort_group_by[key="r", initialize="0 AS n", update="SET n = n + 1"]; g -> a; a -> k;'
    with pytest.raises(LanguageError, match="order"):
        run(spark, unordered)
    named = unordered.replace('key="r", initialize', 'key="r", orderBy="r DESC", initialize')
    assert run(spark, named).count() == 5


def test_fold_arrays(spark):
    text = """g = generate[output="RECORDCOUNT AS r, CAST(RECORDCOUNT AS INTEGER) AS i", numRecords=10];
    k = sort_group_by[initialize="[0, 0, 0] AS n, 0.5e0 AS h", update="SET n[i % 3] = n[i % 3] + i SET h = h * 2"]; c = copy[output="n[0] AS a, n[1] AS b, n[2] AS c, h"]; g -> k; k -> c;"""
    assert tuple(run(spark, text).first()) == (18, 12, 15, 512.0)


def test_switch_sends_null_to_the_first_output(spark):
    text = """g = generate[output="CASE WHEN RECORDCOUNT = 3LL THEN NULL ELSE -1 END AS k", numRecords=5]; s = switch[on="k"]; a = hash_group_by[output="SUM(1) AS n"]; b = hash_group_by[output="SUM(1) AS n"];
    u = union_all[]; g -> s; s -> a; s -> b; a -> u; b -> u;"""
    assert sorted(x["n"] for x in run(spark, text).collect()) == [1, 4]


def test_limit_print_and_dev_null(spark, capsys):
    text = 'g = generate[output="RECORDCOUNT AS r, CASE WHEN RECORDCOUNT % 2LL = 0LL THEN NULL ELSE 1 END AS o", numRecords=20]; p = print[limit=2, where="r > 4LL"]; f = filter[where="r > 2LL", limit=3]; d = devNull[]; g -> p; p -> f; f -> d;'
    assert Graph.parse(text).run(spark) == {}
    assert capsys.readouterr().out == "5\t1\n6\t\\N\n"
    assert [x["r"] for x in run(spark, text.replace("d = devNull[];", "").replace("f -> d;", "")).collect()] == [3, 4, 5]
    capsys.readouterr()
    every = 'g = generate[output="RECORDCOUNT AS r", numRecords=9]; p = print[numToPrint=2, printFrequency=3]; g -> p;'
    run(spark, every)
    assert capsys.readouterr().out == "0\n3\n"


def test_plug_in(spark):
    register_operator("twice", lambda s, node, inputs, n: [type(inputs[0])(inputs[0].df.union(inputs[0].df), inputs[0].fields)])
    try:
        assert run(spark, 'g = generate[output="RECORDCOUNT AS r", numRecords=4]; t = twice[]; g -> t;').count() == 8
    finally:
        del REGISTRY["twice"]


def test_job_partitions_and_orders_by_text(spark):
    job = MapReduceJob('g = generate[output="RECORDCOUNT AS k", numRecords=30]; e = emit[key="k", partition="CAST(k AS INTEGER) % 3 - 3"]; g -> e;', None, 4)
    parts = [[r["k"] for r in p] for p in job.run(spark)["emit"].df.rdd.glom().collect()]
    # -3, -2, -1 as unsigned 32-bit numbers modulo 4 are 1, 2, 3
    assert [sorted({k % 3 for k in p}) for p in parts] == [[], [0], [1], [2]]
    assert all(p == sorted(p, key=str) for p in parts)


def test_filters_are_pushed_down(spark, sf):
    text = f"""l = read[file="{sf}/lineitem.parquet", mode="parquet"]; f = filter[where="l_quantity > 10.0e0 AND l_returnflag = 'R'"]; c = copy[output="l_orderkey"]; l -> f; f -> c;"""
    plan = run(spark, text)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,10.0)" in plan and "EqualTo(l_returnflag,R)" in plan and "l_extendedprice" not in plan


def test_large_tables_are_not_broadcast(spark, monkeypatch):
    from rivulet.operators import join

    text = 'a = generate[output="RECORDCOUNT AS k", numRecords=50]; b = generate[output="RECORDCOUNT AS q", numRecords=50]; j = hash_join[tableKey="k", probeKey="q"]; a -> j; b -> j;'
    assert "BroadcastHashJoin" in run(spark, text)._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(join, "BROADCAST_BYTES", 1)
    assert "ShuffledHashJoin" in run(spark, text)._jdf.queryExecution().executedPlan().toString()
    assert run(spark, text).count() == 50


def test_parser_is_whole():
    with pytest.raises(LanguageError):
        Parser("1 2").single()
    with pytest.raises(LanguageError):
        Parser("a AS 1").record()


VALUES = {
    "i": ("INTEGER", [0, 7, -7, 2147483647, None, -2147483648]), "b": ("BIGINT", [5000000000, -3, None, 0, 9, -9000000000]), "d": ("DOUBLE PRECISION", [2.5, -0.5, 1e10, None, 0.0, 144.0]),
    "m": ("DECIMAL", ["2.5", "-3.5", "1234.567891234", None, "0", "100"]), "s": ("VARCHAR", [" Äb c ", "12.5x", "", None, "1999-02-28", "AbC\t"]),
    "t": ("DATETIME", ["2024-02-29 23:59:59", "1999-12-31 00:00:00", "2011-03-13 02:30:00", None, "2011-11-06 01:30:00", "1970-01-01 12:00:00"]),
}
EXPRESSIONS = [
    "ceil(d)", "floor(d)", "sqrt(d*d)", "log(d)", "log(i)", "exp(d/1.0e11)", "length(s)", "trim(s)", "ltrim(s)", "rtrim(s)", "lower(s)", "upper(s)", "md5(s)", "substr(s, 1, 2)", "substr(s, 2, -1)",
    "substr(s, -2, 2)", "substr(s, 90, 3)", "unix_timestamp(t)", "from_unixtime(b)", "date(t)", "dayofweek(date(t))", "dayofmonth(date(t))", "dayofyear(date(t))", "month(date(t))", "year(date(t))",
    "last_day(date(t))", "datediff(date(t), CAST('2000-01-01' AS DATE))", "julian_day(date(t))", "round(m, 0)", "round(m, 2)", "least(i, b, d)", "greatest(m, i)", "ISNULL(i, 9)", "ifnull(d, i)",
    "i / 2", "i % 5", "b / 7LL", "b % 7LL", "m * m", "m / 7.0", "m + i", "m - d", "d * i", "i & 6", "i | 9", "b ^ 5LL", "~i", "-d", "+m", "i = b", "i < d", "s = 'x'", "m >= 2.5", "s + 'z'",
    "s RLIKE '[0-9.]+x'", "s RLIKE '\\\\p{L}+\\\\s*'", "NOT i > 0", "i > 0 AND b > 0", "i > 0 OR b > 0", "i IS NULL", "CASE WHEN i > 0 THEN i WHEN i < 0 THEN b ELSE NULL END", "CASE WHEN d > 0.0e0 THEN m ELSE 1 END",
    "CAST(b AS INTEGER)", "CAST(d AS VARCHAR)", "CAST(m AS VARCHAR)", "CAST(m AS INTEGER)", "CAST(i AS DECIMAL)", "CAST(d AS DECIMAL)", "CAST(s AS INTEGER)", "CAST(s AS BIGINT)", "CAST(s AS DOUBLE PRECISION)",
    "CAST(s AS DECIMAL)", "CAST(s AS CHAR(3))", "CAST(t AS INTEGER)", "CAST(t AS BIGINT)", "CAST(t AS VARCHAR)", "CAST(date(t) AS VARCHAR)", "CAST(date(t) AS INTEGER)", "CAST(date(t) AS DATETIME)", "CAST(i AS BIGINT)",
    "t + INTERVAL 3 MONTH", "t - INTERVAL 1 YEAR", "t + INTERVAL 40 DAY", "t - INTERVAL 25 HOUR", "t + INTERVAL 61 MINUTE", "t - INTERVAL 1 SECOND", "date(t) + INTERVAL 1 MONTH", "date(t) - INTERVAL 3 DAY",
    "date(t) + INTERVAL 2 HOUR", "INTERVAL 1 YEAR + date(t)", "#(i)", "#(b, d)", "#(s, t, m)", "#(date(t), i, s)", "$(i)", "$(b)", "(i > 0) = (b > 0)",
]


def test_folds_compute_what_columns_do(spark):
    """Every function, operator and interval, over awkward values: the closure's result is the column's."""
    from decimal import Decimal

    from rivulet.functions import expressions as X
    from rivulet.functions import fold
    from rivulet.functions.types import Field, Typed, declared, literal_null
    from rivulet.plans.syntax import Parser

    fields = [Field(n, declared(("DOUBLE" if k.startswith("DOUBLE") else k, None), True)) for n, (k, _) in VALUES.items()]
    convert = {"m": lambda v: Decimal(v), "t": lambda v: __import__("datetime").datetime.fromisoformat(v)}
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    data = [tuple(None if (v := VALUES[n][1][k]) is None else convert.get(n, lambda x: x)(v) for n in VALUES) for k in range(6)]
    df = spark.createDataFrame(data, T.StructType([T.StructField(f.name, f.type.spark) for f in fields])).coalesce(1).withColumn("k", F.monotonically_increasing_id())
    scope = X.Scope({"input": {f.name: Typed(F.col(f.name), f.type) for f in fields}})
    empty = X.Scope({}, {f.name: Typed(literal_null(f.type), f.type) for f in fields})
    rows_ = [r.asDict() for r in df.orderBy("k").collect()]
    for text in EXPRESSIONS:
        node = Parser(text).single()[1]
        value = fold.evaluator(node, lambda n: X.compile_node(n, empty).type)
        made = df.select("k", X.value(text, scope).column.alias("v"))
        try:
            wanted = {r["k"]: r["v"] for r in made.collect()}
        except Exception:  # some row's value is an error: each row for itself
            wanted = {}
            for r in rows_:
                try:
                    wanted[r["k"]] = made.where(F.col("k") == r["k"]).first()["v"]
                except Exception:
                    with pytest.raises(Exception):  # noqa: B017, PT011
                        value(r)
        for r in rows_:
            if r["k"] in wanted:
                want, got = wanted[r["k"]], value(r)
                assert got == (pytest.approx(want, rel=1e-12, nan_ok=True) if isinstance(want, float) else want), (text, r)


def test_return_ends_the_update_of_a_row(spark):
    got = run(spark, """g = generate[output="RECORDCOUNT AS r", numRecords=9];
        k = sort_group_by[initialize="0 AS n, CAST(0 AS BIGINT) AS s", update="SET n = n + 1 IF r % 3LL = 0LL BEGIN RETURN END SET s = s + r"]; g -> k;""").collect()
    assert [tuple(r) for r in got] == [(9, 27)]


def test_initialize_may_declare(spark):
    got = run(spark, """g = generate[output="RECORDCOUNT AS r", numRecords=4]; k = sort_group_by[initialize="DECLARE start = 5, start * 2 AS n", update="SET n = n + CAST(r AS INTEGER)"]; g -> k;""").collect()
    assert [tuple(r) for r in got] == [(16,)]


def test_running_totals_without_keys(spark):
    """Over many ranges, with NULLs and ties, as one pass over the rows in order gives them."""
    got = run(spark, """g = generate[output="(RECORDCOUNT * 7919LL) % 1000LL AS k, CASE WHEN RECORDCOUNT % 5LL < 2LL THEN NULL ELSE RECORDCOUNT % 37LL - 18LL END AS v, RECORDCOUNT AS r", numRecords=1000];
        s = sort[key="k DESC"]; t = sort_group_by[runningtotal="true", output="k, v, SUM(v) AS total, MIN(v) AS low, MAX(v) + SUM(1LL) AS high"]; g -> s; s -> t;""").collect()
    rows = sorted((((i * 7919) % 1000, None if i % 5 < 2 else i % 37 - 18) for i in range(1000)), key=lambda x: -x[0])
    want, seen = [], []
    for n, (k, v) in enumerate(rows, 1):
        seen += [] if v is None else [v]
        want.append((k, v, sum(seen) if seen else None, min(seen, default=None), max(seen) + n if seen else None))
    assert sorted(map(tuple, got), key=lambda x: -x[0]) == want


def test_running_total_of_no_rows(spark):
    assert run(spark, 'g = generate[output="RECORDCOUNT AS r", numRecords=3]; f = filter[where="r > 9LL"]; t = sort_group_by[runningtotal="true", output="SUM(r) AS s"]; g -> f; f -> t;').collect() == []
