"""A query for each operator and part of the language, over the test tables, with the same in SQL.

Doubles are counted in cents as whole numbers, so that results don't depend on the order of sums.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.plans.graph import Graph, MapReduceJob, run
from rivulet.session import shared_path
from rivulet.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def cents(x: str) -> str:
    return f"CAST(CAST(({x})*100.0e0 AS DECIMAL) AS BIGINT)"


def sql_cents(x: str) -> str:
    return f"CAST(round_even(CAST(({x})*100.0e0 AS DECIMAL(28,9)), 0) AS BIGINT)"


def tables(d: str, *names: str) -> str:
    return " ".join(f'{n} = read[file="{d}/{n}.parquet", mode="parquet"];' for n in names)


def script(name: str, inputs: tuple[str, ...], text: str, sql: str | None) -> None:
    """Registers a script; CENTS{x} is x in cents, in both languages."""

    def filled(s: str, make: Callable[[str], str]) -> str:
        out = ""
        while "CENTS{" in s:
            before, _, rest = s.partition("CENTS{")
            body, _, s = rest.partition("}")
            out += before + make(body)
        return out + s

    QUERIES[name] = lambda spark, d: run(spark, tables(d, *inputs) + filled(text, cents))
    if sql:
        ORACLE_SQL[name] = filled(sql, sql_cents)


script(
    "flagship_pricing_summary", ("lineitem",),
    """f = filter[where="l_shipdate <= CAST('1998-09-02' AS DATETIME)"];
    g = hash_group_by[key="l_returnflag", key="l_linestatus", output="l_returnflag, l_linestatus, SUM(CENTS{l_quantity}) AS sum_qty,
        SUM(CENTS{l_extendedprice}) AS sum_base, SUM(CENTS{l_extendedprice*(1.0e0-l_discount)}) AS sum_disc, MIN(l_tax) AS min_tax, MAX(l_tax) AS max_tax, SUM(1LL) AS n"];
    s = sort[key="l_returnflag", key="l_linestatus"]; lineitem -> f; f -> g; g -> s;""",
    """SELECT l_returnflag, l_linestatus, CAST(sum(CENTS{l_quantity}) AS BIGINT) AS sum_qty, CAST(sum(CENTS{l_extendedprice}) AS BIGINT) AS sum_base,
        CAST(sum(CENTS{l_extendedprice*(1.0e0-l_discount)}) AS BIGINT) AS sum_disc, min(l_tax) AS min_tax, max(l_tax) AS max_tax, count(*) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""",
)
script(
    "read_projection", (), 'o = read[file="SF/orders.parquet", mode="parquet", output="o_orderkey,o_orderpriority"];', "SELECT o_orderkey, o_orderpriority FROM orders"
)
QUERIES["read_projection"] = lambda spark, d: run(spark, f'o = read[file="{d}/orders.parquet", mode="parquet", output="o_orderkey,o_orderpriority"];')
script(
    "generate_series", (),
    'g = generate[output="RECORDCOUNT AS r, RECORDCOUNT/5 AS q, RECORDCOUNT % 3 AS m, CAST(RECORDCOUNT AS INTEGER) - 7 AS i, PARTITION AS p, PARTITIONCOUNT AS c", numRecords=100, partitions=3];',
    "SELECT i % 100 AS r, (i % 100) // 5 AS q, (i % 100) % 3 AS m, CAST(i % 100 - 7 AS INTEGER) AS i, CAST(i // 100 AS INTEGER) AS p, 3 AS c FROM (SELECT unnest(range(300)) AS i)",
)
script(
    "filter_where", ("orders",), """f = filter[where="o_totalprice > 100000.0e0 AND o_orderstatus <> 'F' OR o_orderpriority RLIKE '[12]-.*'"]; orders -> f;""",
    "SELECT * FROM orders WHERE o_totalprice > 100000 AND o_orderstatus <> 'F' OR regexp_full_match(o_orderpriority, '[12]-.*')",
)
script(
    "filter_null_drops", ("events",), """c = copy[output="event_id, CASE WHEN event_id % 4LL = 1LL THEN NULL ELSE event_id % 7LL END AS k"]; f = filter[where="k <> 3"]; events -> c; c -> f;""",
    "SELECT event_id, k FROM (SELECT event_id, CASE WHEN event_id % 4 = 1 THEN NULL ELSE event_id % 7 END AS k FROM events) WHERE k <> 3",
)
script(
    "filter_declare", ("lineitem",), """f = filter[where="DECLARE net = l_extendedprice*(1.0e0-l_discount), net > 90000.0e0"]; c = copy[output="l_orderkey, l_linenumber"]; lineitem -> f; f -> c;""",
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_extendedprice*(1.0e0-l_discount) > 90000",
)
script(
    "sort_limit_topk", ("orders",), """s = sort[key="o_totalprice DESC", key="o_orderkey"]; f = filter[limit=10]; c = copy[output="o_orderkey, o_totalprice"]; orders -> s; s -> f; f -> c;""",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
)
script(
    "copy_project", ("customer",), """c = copy[output="input.*, c_nationkey*2 + 1 AS twice, upper(c_mktsegment) AS segment, DECLARE k = c_custkey % 10LL, k*k AS square"]; customer -> c;""",
    "SELECT *, c_nationkey*2+1 AS twice, upper(c_mktsegment) AS segment, (c_custkey % 10)*(c_custkey % 10) AS square FROM customer",
)
script(
    "copy_two_outputs", ("supplier",), """c = copy[output="s_suppkey AS k, 'low' AS side", output="s_suppkey + 1000000LL AS k, 'high' AS side"]; u = union_all[]; supplier -> c; c -> u; c -> u;""",
    "SELECT s_suppkey AS k, 'low' AS side FROM supplier UNION ALL SELECT s_suppkey + 1000000, 'high' FROM supplier",
)
script("regex_project", ("lineitem",), 'c = copy[output="`l_.*key`"]; lineitem -> c;', "SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem")
script(
    "regex_rename", ("part",), r'c = copy[output="`p_(name|size)` AS `$1_of_part`, p_partkey"]; part -> c;',
    "SELECT p_name AS name_of_part, p_size AS size_of_part, p_partkey FROM part",
)
script(
    "switch_route", ("orders",),
    """w = switch[on="CAST(o_orderkey AS INTEGER)"]; a = hash_group_by[output="0 AS way, SUM(1LL) AS n"]; b = hash_group_by[output="1 AS way, SUM(1LL) AS n"]; c = hash_group_by[output="2 AS way, SUM(1LL) AS n"];
    u = union_all[]; orders -> w; w -> a; w -> b; w -> c; a -> u; b -> u; c -> u;""",
    "SELECT CAST(o_orderkey % 3 AS INTEGER) AS way, count(*) AS n FROM orders GROUP BY 1",
)
script(
    "union_all_names", ("customer", "supplier"),
    """a = copy[output="c_name AS name, c_nationkey AS nation"]; b = copy[output="s_name AS n, s_nationkey AS k"]; u = union_all[]; customer -> a; supplier -> b; a -> u; b -> u;""",
    "SELECT c_name AS name, c_nationkey AS nation FROM customer UNION ALL SELECT s_name, s_nationkey FROM supplier",
)
script(
    "union_all_concat", (),
    """a = generate[output="RECORDCOUNT AS a, 'x' AS b", numRecords=200]; b = generate[output="RECORDCOUNT AS a, 'y' AS b", numRecords=300]; u = union_all[concatenate="true"]; f = filter[limit=250]; a -> u; b -> u; u -> f;""",
    "SELECT i AS a, 'x' AS b FROM (SELECT unnest(range(200)) AS i) UNION ALL SELECT i, 'y' FROM (SELECT unnest(range(50)) AS i)",
)
script(
    "unpivot_lineitem", ("lineitem",),
    """c = copy[output="l_returnflag, l_quantity, l_discount, l_tax"]; u = unpivot[columnPattern="l_(quantity|discount|tax)", pivotColumn="metric", valueColumn="value"];
    g = hash_group_by[key="metric", key="l_returnflag", output="metric, l_returnflag, SUM(CENTS{value}) AS total, SUM(1LL) AS n"]; lineitem -> c; c -> u; u -> g;""",
    """SELECT metric, l_returnflag, CAST(sum(CENTS{value}) AS BIGINT) AS total, count(*) AS n FROM
    (SELECT l_returnflag, unnest(['quantity','discount','tax']) AS metric, unnest([l_quantity, l_discount, l_tax]) AS value FROM lineitem) GROUP BY ALL""",
)
# rows are compared as bags, so sorts are followed by a count of the rows so far, which tells the order
_PLACE = 'n = sort_group_by[runningtotal="true", output="{}, SUM(1LL) AS place"]; s -> n;'
script(
    "sort_multi", ("part",), 's = sort[key="p_size DESC", key="p_name", key="p_partkey"]; part -> s; ' + _PLACE.format("p_size, p_name, p_partkey"),
    "SELECT p_size, p_name, p_partkey, row_number() OVER (ORDER BY p_size DESC, p_name, p_partkey) AS place FROM part",
)
script(
    "sort_presorted", ("nation",), 's = sort[presorted="n_regionkey", key="n_name DESC"]; f = filter[limit=7]; nation -> s; s -> f;',
    "SELECT * FROM nation ORDER BY n_regionkey, n_name DESC LIMIT 7",
)
script(
    "sort_merge_two", ("customer", "supplier"),
    """a = copy[output="c_nationkey AS k, c_custkey AS id"]; b = copy[output="s_nationkey AS k, -s_suppkey AS id"]; x = sort[key="k", key="id"]; y = sort[key="k", key="id"]; s = sort_merge[key="k", key="id"]; customer -> a; supplier -> b; a -> x; b -> y; x -> s; y -> s; """
    + _PLACE.format("k, id"),
    "SELECT *, row_number() OVER (ORDER BY k, id) AS place FROM (SELECT c_nationkey AS k, c_custkey AS id FROM customer UNION ALL SELECT s_nationkey, -s_suppkey FROM supplier)",
)
script(
    "sort_null_low", ("customer",), """c = copy[output="c_custkey, CASE WHEN c_custkey % 5LL = 0LL THEN NULL ELSE c_custkey % 11LL END AS k"]; s = sort[key="k DESC", key="c_custkey"]; f = filter[limit=50]; customer -> c; c -> s; s -> f;""",
    "SELECT c_custkey, k FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey % 11 END AS k FROM customer) ORDER BY k DESC NULLS LAST, c_custkey LIMIT 50",
)

_SIDES = "customer -> j; orders -> j;"
_CO = "c_custkey, c_mktsegment, o_orderkey, o_totalprice"
for strategy, a, b, x, y in (("hash", "tableKey", "probeKey", "table", "probe"), ("merge", "leftKey", "rightKey", "l", "r")):
    keys = f'{a}="c_custkey", {b}="o_custkey"'
    residual = 'residual="c_acctbal > 0.0e0"'
    for kind, how in (("", "JOIN"), ("left_outer_", "LEFT JOIN"), ("right_outer_", "RIGHT JOIN"), ("full_outer_", "FULL JOIN")):
        script(
            f"{strategy}_{kind}join", ("customer", "orders"), f'j = {strategy}_{kind}join[{keys}, {residual}, output="{_CO}, ISNULL(o_totalprice, -1.0e0) AS price"]; {_SIDES}',
            f"SELECT {_CO}, ifnull(o_totalprice, -1.0) AS price FROM customer {how} orders ON c_custkey = o_custkey AND c_acctbal > 0",
        )
    for kind, no in (("right_semi_", ""), ("right_anti_semi_", "NOT ")):
        script(
            f"{strategy}_{kind}join", ("customer", "orders"), f"j = {strategy}_{kind}join[{keys}, {residual}]; {_SIDES}",
            f"SELECT * FROM orders WHERE {no}EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)",
        )
    script(
        f"{strategy}_join_composite", ("lineitem", "orders"),
        f"""k = copy[output="o_orderkey AS ok, o_orderkey % 7LL AS om, o_orderpriority"]; t = copy[output="l_orderkey, l_orderkey % 7LL AS lm, l_linenumber"];
        j = {strategy}_join[{a}="ok", {a}="om", {b}="l_orderkey", {b}="lm", output="{x}.*, {y}.l_linenumber"]; orders -> k; lineitem -> t; k -> j; t -> j;""",
        "SELECT o_orderkey AS ok, o_orderkey % 7 AS om, o_orderpriority, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey",
    )
    script(
        f"{strategy}_join_null_keys", ("customer", "nation"),
        f"""n = copy[output="CASE WHEN n_nationkey < 3 THEN NULL ELSE n_nationkey END AS k, n_name"]; c = copy[output="c_custkey, CASE WHEN c_nationkey < 5 THEN NULL ELSE CAST(c_nationkey AS BIGINT) END AS q"];
        j = {strategy}_full_outer_join[{a}="k", {b}="q"]; nation -> n; customer -> c; n -> j; c -> j;""",
        """SELECT * FROM (SELECT CASE WHEN n_nationkey < 3 THEN NULL ELSE n_nationkey END AS k, n_name FROM nation)
        FULL JOIN (SELECT c_custkey, CASE WHEN c_nationkey < 5 THEN NULL ELSE CAST(c_nationkey AS BIGINT) END AS q FROM customer) ON k = q""",
    )
script(
    "cross_join_theta", ("region", "nation"), 'j = hash_join[where="r_regionkey < n_regionkey", output="r_name, n_name"]; region -> j; nation -> j;',
    "SELECT r_name, n_name FROM region, nation WHERE r_regionkey < n_regionkey",
)
script("cross_join", ("region", "nation"), "j = hash_join[]; region -> j; nation -> j;", "SELECT * FROM region, nation")
script(
    "join_same_names", ("nation", "region"),
    """a = copy[output="n_regionkey AS k, n_name AS name"]; b = copy[output="r_regionkey AS k, r_name AS name"]; j = hash_join[tableKey="k", probeKey="k", output="table.name AS region, probe.name AS nation, table.k AS k"]; nation -> a; region -> b; b -> j; a -> j;""",
    "SELECT r_name AS region, n_name AS nation, r_regionkey AS k FROM region JOIN nation ON r_regionkey = n_regionkey",
)
for name in ("hash_group_by", "sort_group_by"):
    script(
        name, ("lineitem",), f'g = {name}[key="l_suppkey", output="l_suppkey, SUM(1LL) AS n, MIN(l_shipdate) AS first, MAX(l_shipdate) AS last, MAX(l_linenumber) - MIN(l_linenumber) AS spread"]; lineitem -> g;',
        "SELECT l_suppkey, count(*) AS n, min(l_shipdate) AS first, max(l_shipdate) AS last, max(l_linenumber) - min(l_linenumber) AS spread FROM lineitem GROUP BY 1",
    )
script(
    "hybrid_group_by", ("events",), 'g = group_by[sortKey="user_id", hashKey="event_type", output="user_id, event_type, SUM(1LL) AS n"]; events -> g;',
    "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2",
)
script(
    "global_agg", ("orders",), 'f = filter[where="o_orderkey < 0LL"]; a = hash_group_by[output="1 AS part, SUM(1LL) AS n, MAX(o_orderkey) AS top"]; b = sort_group_by[output="2 AS part, SUM(1LL) AS n, MAX(o_orderkey) AS top"]; c = copy[output="input.*", output="input.*"]; u = union_all[]; orders -> c; c -> f; f -> a; c -> b; a -> u; b -> u;',
    "SELECT 1 AS part, CAST(NULL AS BIGINT) AS n, CAST(NULL AS BIGINT) AS top UNION ALL SELECT 2, count(*), max(o_orderkey) FROM orders",
)
script("distinct", ("orders",), 'g = hash_group_by[key="o_orderstatus", key="o_orderpriority", output="o_orderstatus, o_orderpriority"]; orders -> g;', "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
script(
    "count_distinct_two_level", ("lineitem",),
    'a = hash_group_by[key="l_returnflag", key="l_partkey", output="l_returnflag, l_partkey"]; b = hash_group_by[key="l_returnflag", output="l_returnflag, SUM(1LL) AS parts"]; lineitem -> a; a -> b;',
    "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1",
)
script(
    "group_by_null_key", ("orders",), """c = copy[output="CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderstatus END AS k, CASE WHEN o_orderkey % 4LL = 1LL THEN NULL ELSE o_orderkey END AS v"]; g = hash_group_by[key="k", output="k, SUM(v) AS total, MIN(v) AS low"]; orders -> c; c -> g;""",
    "SELECT CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderstatus END AS k, CAST(sum(CASE WHEN o_orderkey % 4 = 1 THEN NULL ELSE o_orderkey END) AS BIGINT) AS total, min(CASE WHEN o_orderkey % 4 = 1 THEN NULL ELSE o_orderkey END) AS low FROM orders GROUP BY 1",
)
script(
    "conditional_sum", ("lineitem",), """g = hash_group_by[key="l_linestatus", output="l_linestatus, SUM(CASE WHEN l_returnflag = 'R' THEN 1LL ELSE 0LL END) AS returned, SUM(CASE WHEN l_discount > 0.05e0 THEN 1LL END) AS cheap"]; lineitem -> g;""",
    "SELECT l_linestatus, count(*) FILTER (l_returnflag = 'R') AS returned, count(*) FILTER (l_discount > 0.05) AS cheap FROM lineitem GROUP BY 1",
)
script(
    "group_by_having", ("orders",), 'g = hash_group_by[key="o_custkey", output="o_custkey, SUM(1LL) AS n"]; f = filter[where="n > 12LL"]; orders -> g; g -> f;',
    "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12",
)
_RUN = 's = sort[key="user_id", key="ts", key="event_id"]; events -> s; s -> g;'
_OVER = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"
script(
    "running_total", ("events",), f'g = sort_group_by[key="user_id", runningtotal="true", output="event_id, user_id, SUM(CENTS{{value}}) AS total, MIN(event_id) AS low, MAX(event_id) + SUM(1LL) AS mixed"]; {_RUN}',
    f"SELECT event_id, user_id, CAST(sum(CENTS{{value}}) {_OVER} AS BIGINT) AS total, min(event_id) {_OVER} AS low, max(event_id) {_OVER} + count(*) {_OVER} AS mixed FROM events",
)
script(
    "fold_bins", ("events",),
    f"""g = sort_group_by[key="user_id", initialize="CAST(0 AS BIGINT) AS bin1, CAST(0 AS BIGINT) AS bin2", update="
        DECLARE c = event_id % 100LL DECLARE room BIGINT SET room = CASE WHEN bin1 + c < 2000LL THEN c ELSE 2000LL - bin1 END SET bin1 = bin1 + room SET bin2 = bin2 + c - room"]; {_RUN}""",
    "SELECT user_id, CAST(least(sum(event_id % 100), 2000) AS BIGINT) AS bin1, CAST(sum(event_id % 100) - least(sum(event_id % 100), 2000) AS BIGINT) AS bin2 FROM events GROUP BY 1",
)
script(
    "fold_running", ("events",),
    f"""g = sort_group_by[key="user_id", runningtotal="true", initialize="99999999999LL AS low, CAST(0 AS BIGINT) AS total, 0 AS n", update="
        SET low = CASE WHEN event_id < low THEN event_id ELSE low END SET total = total + event_id IF n < 5 BEGIN SET n = n + 1 END"]; {_RUN}""",
    f"SELECT user_id, min(event_id) {_OVER} AS low, CAST(sum(event_id) {_OVER} AS BIGINT) AS total, CAST(least(count(*) {_OVER}, 5) AS INTEGER) AS n FROM events",
)
script(
    "fold_loop_switch", ("orders",),
    """s = sort[key="o_custkey", key="o_orderkey"]; g = sort_group_by[key="o_custkey", initialize="0 AS odd, 0 AS even, 0 AS steps", update="
        SWITCH CAST(o_orderkey % 2LL AS INTEGER) BEGIN CASE 0 SET even = even + 1 CASE 1 SET odd = odd + 1 END
        DECLARE i INTEGER SET i = 0 WHILE i < 3 DO SET i = i + 1 SET steps = steps + i END WHILE"]; orders -> s; s -> g;""",
    "SELECT o_custkey, CAST(count(*) FILTER (o_orderkey % 2 = 1) AS INTEGER) AS odd, CAST(count(*) FILTER (o_orderkey % 2 = 0) AS INTEGER) AS even, CAST(6 * count(*) AS INTEGER) AS steps FROM orders GROUP BY 1",
)
_FOLD = 'g = sort_group_by[key="{key}", orderBy="{key}", initialize="{first}", update="{update}"]; {table} -> g;'


def both_ways(name: str, table: str, key: str, names: dict[str, tuple[str, str]], sql: str, declare: str = "") -> None:
    """A query of columns, scalar_..., and one of the same in a fold, fold_...: names has the expression and the state to begin with."""
    columns = ", ".join([key, *([f"DECLARE {declare}"] if declare else []), *[f"{x} AS {n}" for n, (x, _) in names.items()]])
    script(f"scalar_{name}", (table,), f'c = copy[output="{columns}"]; {table} -> c;', sql)
    first, update = ", ".join(f"{x} AS {n}" for n, (_, x) in names.items()), " ".join([*([f"DECLARE {declare}"] if declare else []), *[f"SET {n} = {x}" for n, (x, _) in names.items()]])
    script(f"fold_{name}", (table,), _FOLD.format(key=key, first=first, update=update, table=table), sql)


_TEXT, _INT, _LONG, _DATE, _TIME, _REAL = "''", "0", "0LL", "CAST('1970-01-01' AS DATE)", "CAST('1970-01-01' AS DATETIME)", "0.0e0"
both_ways(
    "strings", "customer", "c_custkey",
    {
        "len": ("length(c_name)", _INT), "mid": ("substr(c_name, 3, 4)", _TEXT), "tail": ("substr(c_name, 9, -1)", _TEXT), "low": ("lower(c_name)", _TEXT), "up": ("upper(c_mktsegment)", _TEXT),
        "bare": ("trim('  ' + c_mktsegment + '\\t ')", _TEXT), "both": ("c_name + '/' + c_mktsegment", _TEXT), "four": ("CAST(c_mktsegment AS CHAR(4))", "CAST('' AS CHAR(4))"),
        "auto": ("c_mktsegment RLIKE '(?i)auto.*'", _INT), "digest": ("md5(c_name)", _TEXT), "left": ("ltrim('  ' + c_mktsegment + ' ')", _TEXT), "right": ("rtrim('  ' + c_mktsegment + ' ')", _TEXT),
        "bytes": ("length('é' + c_name)", _INT), "after": ("substr('é' + c_name, 2, 3)", _TEXT), "plain": ("lower('É') + upper('é')", _TEXT),
    },
    """SELECT c_custkey, CAST(strlen(c_name) AS INTEGER) AS len, substr(c_name, 4, 4) AS mid, substr(c_name, 10) AS tail, lower(c_name) AS low, upper(c_mktsegment) AS up, c_mktsegment AS bare,
        c_name || '/' || c_mktsegment AS both, rpad(c_mktsegment, 4, ' ') AS four, CAST(regexp_full_match(c_mktsegment, '(?i)auto.*') AS INTEGER) AS auto, md5(c_name) AS digest,
        c_mktsegment || ' ' AS left, '  ' || c_mktsegment AS right, CAST(strlen(c_name) + 2 AS INTEGER) AS bytes, left(c_name, 3) AS after, 'Éé' AS plain FROM customer""",
)
both_ways(
    "dates", "orders", "o_orderkey",
    {
        "y": ("year(d)", _INT), "m": ("month(d)", _INT), "dom": ("dayofmonth(d)", _INT), "doy": ("dayofyear(d)", _INT), "dow": ("dayofweek(d)", _INT), "last": ("last_day(d)", _DATE),
        "days": ("datediff(d, CAST('1995-01-01' AS DATE))", _INT), "julian": ("julian_day(d)", _INT), "ymd": ("CAST(d AS INTEGER)", _INT), "stamp": ("CAST(o_orderdate AS BIGINT)", _LONG),
        "same": ("from_unixtime(unix_timestamp(o_orderdate)) = o_orderdate", _INT), "known": ("unix_timestamp(CAST('2011-02-17 15:38:33' AS DATETIME))", _LONG),
        "back": ("from_unixtime(1326391943LL)", _TIME), "recent": ("utc_timestamp() > o_orderdate", _INT),
    },
    """SELECT o_orderkey, CAST(year(d) AS INTEGER) AS y, CAST(month(d) AS INTEGER) AS m, CAST(day(d) AS INTEGER) AS dom, CAST(dayofyear(d) AS INTEGER) AS doy, CAST(dayofweek(d)+1 AS INTEGER) AS dow, last_day(d) AS last,
        CAST(datediff('day', DATE '1995-01-01', d) AS INTEGER) AS days, CAST(julian(d) AS INTEGER) AS julian, CAST(strftime(d, '%Y%m%d') AS INTEGER) AS ymd, CAST(strftime(o_orderdate, '%Y%m%d%H%M%S') AS BIGINT) AS stamp,
        1 AS same, CAST(1297975113 AS BIGINT) AS known, TIMESTAMP '2012-01-12 13:12:23' AS back, 1 AS recent
    FROM (SELECT o_orderkey, o_orderdate, CAST(o_orderdate AS DATE) AS d FROM orders)""",
    "d = date(o_orderdate)",
)
both_ways(
    "intervals", "orders", "o_orderkey",
    {
        "d5": ("d + INTERVAL 5 DAY", _DATE), "y2": ("d - INTERVAL 2 YEAR", _DATE), "m1": ("d + INTERVAL 1 MONTH", _DATE), "h3": ("d + INTERVAL 3 HOUR", _TIME),
        "back": ("o_orderdate - INTERVAL 90 MINUTE", _TIME), "s7": ("o_orderdate + INTERVAL 7 SECOND", _TIME), "varied": ("INTERVAL CAST(o_orderkey % 5LL AS INTEGER) DAY + d", _DATE),
    },
    """SELECT o_orderkey, CAST(d + INTERVAL 5 DAY AS DATE) AS d5, CAST(CASE WHEN d = last_day(d) THEN last_day(d - INTERVAL 2 YEAR) ELSE d - INTERVAL 2 YEAR END AS DATE) AS y2,
        CAST(CASE WHEN d = last_day(d) THEN last_day(d + INTERVAL 1 MONTH) ELSE d + INTERVAL 1 MONTH END AS DATE) AS m1, CAST(d AS TIMESTAMP) + INTERVAL 3 HOUR AS h3, o_orderdate - INTERVAL 90 MINUTE AS back, o_orderdate + INTERVAL 7 SECOND AS s7,
        CAST(d + CAST(o_orderkey % 5 AS INTEGER) AS DATE) AS varied FROM (SELECT o_orderkey, o_orderdate, CAST(o_orderdate AS DATE) AS d FROM orders)""",
    "d = date(o_orderdate)",
)
both_ways(
    "math", "part", "p_partkey",
    {
        "q": ("i/7", _INT), "r": ("i % 7", _INT), "neg": ("-i", _INT), "inv": ("~i", _INT), "a": ("i & 12", _INT), "o": ("i | 5", _INT), "x": ("i ^ 9", _INT), "loose": ("8 | 1 = 1", _INT),
        "up": ("ceil(p_retailprice)", _REAL), "down": ("floor(p_retailprice)", _REAL), "low": ("least(i, p_size, 20)", _INT), "high": ("greatest(i, p_size)", _INT), "side": ("i > 0 ? 1 : 2", _INT),
        "seventh": ("CAST(round(CAST(p_retailprice AS DECIMAL)/7.0, 0) AS BIGINT)", _LONG), "tenths": ("CAST(p_retailprice AS DECIMAL)*0.1", "0.0"), "root": ("CAST(sqrt(CAST(CAST(i AS BIGINT)*i AS DOUBLE PRECISION)) AS INTEGER)", _INT),
        "power": ("CAST(round(CAST(exp(log(p_retailprice)) AS DECIMAL), 2)*100 AS BIGINT)", _LONG), "first": ("$(i)", _INT), "long": ("$(p_partkey)", _INT), "alike": ("#(p_partkey, p_name) = #(p_partkey, p_name)", _INT),
    },
    """SELECT p_partkey, i // 7 AS q, i % 7 AS r, -i AS neg, ~i AS inv, i & 12 AS a, i | 5 AS o, xor(i, 9) AS x, 8 | 1 AS loose, ceil(p_retailprice) AS up, floor(p_retailprice) AS down,
        least(i, p_size, 20) AS low, greatest(i, p_size) AS high, CASE WHEN i > 0 THEN 1 ELSE 2 END AS side, CAST(round_even(CAST(CAST(p_retailprice AS DECIMAL(28,9))/7 AS DECIMAL(28,6)), 0) AS BIGINT) AS seventh,
        CAST(CAST(p_retailprice AS DECIMAL(18,6)) * 0.1 AS DECIMAL(28,9)) AS tenths, abs(i) AS root, CAST(round_even(p_retailprice * 100, 0) AS BIGINT) AS power,
        CAST((CAST(i AS BIGINT) + 2147483648) >> 1 AS INTEGER) AS first, CAST((CAST(p_partkey AS HUGEINT) + 9223372036854775808) // 8589934592 AS INTEGER) AS long, 1 AS alike
    FROM (SELECT *, CAST(p_partkey AS INTEGER) - 700 AS i FROM part)""",
    "i = CAST(ISNULL(p_partkey, 0LL) AS INTEGER) - 700",
)
script(
    "arrays", ("nation",), """c = copy[output="n_nationkey, DECLARE a = [ISNULL(n_regionkey, 0), 7, ISNULL(n_nationkey, 0)], a[0] + a[2] AS ends, a[n_regionkey % 1 + 1] AS mid"]; nation -> c;""",
    "SELECT n_nationkey, n_regionkey + n_nationkey AS ends, 7 AS mid FROM nation",
)
script(
    "casts", ("orders",),
    """c = copy[output="o_orderkey, CAST(o_totalprice AS INTEGER) AS whole, CAST(o_orderpriority AS INTEGER) AS leading, CAST(o_orderstatus AS BIGINT) AS none, CAST(2.5 AS INTEGER) AS even, CAST(3.5 AS INTEGER) AS odd,
        CAST(o_orderkey AS VARCHAR) AS text, CAST(date(o_orderdate) AS VARCHAR) AS day, CAST(o_orderdate AS VARCHAR) AS stamp, CAST('1996-07-04' AS DATE) AS fourth, CAST(CAST('1996-07-04' AS DATE) AS DATETIME) AS midnight, CAST(o_orderkey AS DOUBLE PRECISION) AS d"]; orders -> c;""",
    """SELECT o_orderkey, CAST(trunc(o_totalprice) AS INTEGER) AS whole, CAST(left(o_orderpriority, 1) AS INTEGER) AS leading, CAST(0 AS BIGINT) AS none, 2 AS even, 4 AS odd, CAST(o_orderkey AS VARCHAR) AS text,
        strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS stamp, DATE '1996-07-04' AS fourth, TIMESTAMP '1996-07-04' AS midnight, CAST(o_orderkey AS DOUBLE) AS d FROM orders""",
)
script(
    "null_logic", (),
    """g = generate[output="RECORDCOUNT AS i, CASE WHEN RECORDCOUNT/3LL = 0LL THEN 1 WHEN RECORDCOUNT/3LL = 1LL THEN 0 ELSE NULL END AS a, CASE WHEN RECORDCOUNT % 3LL = 0LL THEN 1 WHEN RECORDCOUNT % 3LL = 1LL THEN 0 ELSE NULL END AS b", numRecords=9];
    c = copy[output="i, a = 1 AND b = 1 AS both, a = 1 OR b = 1 AS any, NOT (a = 1 AND b = 1) AS nand, a IS NULL AS no_a, a + b AS total, ISNULL(a, 7) AS seven, b <> 0 AND 1/b > 0 AS guarded"]; g -> c;""",
    """SELECT i, CAST(CASE WHEN a = 1 THEN b = 1 ELSE FALSE END AS INTEGER) AS both, CAST(CASE WHEN a = 1 THEN TRUE ELSE b = 1 END AS INTEGER) AS any, CAST(NOT (CASE WHEN a = 1 THEN b = 1 ELSE FALSE END) AS INTEGER) AS nand,
        CAST(a IS NULL AS INTEGER) AS no_a, a + b AS total, ifnull(a, 7) AS seven, CAST(CASE WHEN b <> 0 THEN 1 // b > 0 ELSE FALSE END AS INTEGER) AS guarded
    FROM (SELECT i, CASE i // 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS a, CASE i % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS b FROM (SELECT unnest(range(9)) AS i))""",
)
script(
    "unix_time", ("orders",), """c = copy[output="o_orderkey, from_unixtime(unix_timestamp(o_orderdate)) = o_orderdate AS same, unix_timestamp(CAST('2011-02-17 15:38:33' AS DATETIME)) AS known, from_unixtime(1326391943LL) AS back"]; orders -> c;""",
    "SELECT o_orderkey, 1 AS same, CAST(1297975113 AS BIGINT) AS known, TIMESTAMP '2012-01-12 13:12:23' AS back FROM orders",
)


def text_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """nation as gzipped text with header, NULLs and schema, read back."""
    path = shared_path(spark, "nation") + ".gz"
    run_ = f"""{tables(d, "nation")} c = copy[output="n_nationkey, CASE WHEN n_regionkey = 2 THEN NULL ELSE n_name END AS name, CAST(n_regionkey AS DOUBLE PRECISION)/4.0e0 AS quarter, CAST('1999-12-31' AS DATE) AS d"];
        w = write[file="{path}", mode="text", header="true", formatFile="{path}.format"]; nation -> c; c -> w;"""
    Graph.parse(run_).run(spark)
    return run(spark, f'r = read[file="{path}", mode="text", formatFile="{path}.format", skipHeader="true"];')


QUERIES["text_roundtrip"] = text_roundtrip
ORACLE_SQL["text_roundtrip"] = "SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN NULL ELSE n_name END AS name, n_regionkey / 4.0e0 AS quarter, DATE '1999-12-31' AS d FROM nation"


def text_dynamic(spark: SparkSession, d: str) -> DataFrame:
    """Rows written to a folder for each market segment, counted by folder."""
    path = shared_path(spark, "segments")
    Graph.parse(f"""{tables(d, "customer")} w = write[connect="{path}", file="lower(c_mktsegment)", mode="text"]; customer -> w;""").run(spark)
    back = spark.read.text(path)
    return back.groupBy(F.col("dir").cast("string").alias("segment")).agg(F.count("*").alias("n"))


QUERIES["text_dynamic"] = text_dynamic
ORACLE_SQL["text_dynamic"] = "SELECT lower(c_mktsegment) AS segment, count(*) AS n FROM customer GROUP BY 1"


def map_reduce(spark: SparkSession, d: str) -> DataFrame:
    """Events by type, in two stages."""
    job = MapReduceJob(
        tables(d, "events") + """c = copy[output="event_type, user_id, 1LL AS one"]; e = emit[key="event_type"]; events -> c; c -> e;""",
        """r = reduce[]; g = sort_group_by[key="event_type", output="event_type, SUM(one) AS n, MAX(user_id) AS top"]; r -> g;""",
        4,
    )
    return job.run(spark)["g"].visible()


QUERIES["map_reduce"] = map_reduce
ORACLE_SQL["map_reduce"] = "SELECT event_type, count(*) AS n, max(user_id) AS top FROM events GROUP BY 1"


def map_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of text through map, emit by an expression, and reduce with a format of its own."""
    lines = spark.read.parquet(f"{d}/nation.parquet").select(F.concat_ws("|", "n_nationkey", "n_name", "n_regionkey").alias("value"))
    job = MapReduceJob(
        """m = map[format="k INTEGER, name VARCHAR, region INTEGER", fieldSeparator="|"]; e = emit[key="region", partition="region * 3"]; m -> e;""",
        """r = reduce[format="id BIGINT, name VARCHAR, region INTEGER"]; g = hash_group_by[key="region", output="region, SUM(id) AS total, MIN(name) AS first"]; r -> g;""",
        4,
    )
    return job.run(spark, lines)["g"].visible()


QUERIES["map_lines"] = map_lines
ORACLE_SQL["map_lines"] = "SELECT n_regionkey AS region, CAST(sum(n_nationkey) AS BIGINT) AS total, min(n_name) AS first FROM nation GROUP BY 1"


def broadcast_read(spark: SparkSession, d: str) -> DataFrame:
    text = f'n = read[file="{d}/nation.parquet", mode="parquet", broadcast="true"]; {tables(d, "supplier")} j = hash_join[tableKey="n_nationkey", probeKey="s_nationkey", output="s_suppkey, n_name"]; n -> j; supplier -> j;'
    return run(spark, text)


QUERIES["broadcast_read"] = broadcast_read
ORACLE_SQL["broadcast_read"] = "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey"


def bucketed_read(spark: SparkSession, d: str) -> DataFrame:
    """Files serial_ddddd.gz in one folder, read as one relation."""
    path = shared_path(spark, "buckets")
    rows = spark.read.parquet(f"{d}/region.parquet").select(F.concat_ws("\t", "r_regionkey", "r_name").alias("value"))
    rows.coalesce(1).write.text(f"{path}/serial_00000.gz", compression="gzip")
    rows.coalesce(1).write.text(f"{path}/serial_00001.gz", compression="gzip")
    fields = files.read_format(spark, "k INTEGER, name VARCHAR", None)
    return files.read_text(spark, path, fields, bucketed=True).visible()


QUERIES["bucketed_read"] = bucketed_read
ORACLE_SQL["bucketed_read"] = "SELECT r_regionkey AS k, r_name AS name FROM region UNION ALL SELECT r_regionkey, r_name FROM region"


def constant_rows(spark: SparkSession, d: str) -> DataFrame:
    return files.constant(spark, [(1, "one"), (2, None)], files.read_format(spark, "k INTEGER, name VARCHAR NULL", None)).visible()


def graph(spark: SparkSession, text: str, **given) -> None:
    """Runs a script for what its sinks do."""
    Graph.parse(text).run(spark, given)


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


@query("SELECT * FROM (VALUES ('a'), (''), ('  '), ('b')) v(line) UNION ALL SELECT * FROM (VALUES ('a'), (''), ('  '), ('b')) w(line)")
def read_skip_header(spark: SparkSession, d: str) -> DataFrame:
    """Two files with a header and blank lines, which are lines."""
    path = shared_path(spark, "headed")
    one = spark.createDataFrame([("head\na\n\n  \nb",)], "value string").coalesce(1)
    for _ in range(2):
        one.write.mode("append").text(path)
    return run(spark, f'r = read[file="{path}/part-*", mode="text", format="line VARCHAR", skipHeader="true"];')


@query("SELECT n_name AS name, CAST(n_nationkey AS INTEGER) AS k FROM nation WHERE n_regionkey > 0")
def read_comments_projection(spark: SparkSession, d: str) -> DataFrame:
    """Lines with comments between; a middle field is skipped, others change places."""
    path = shared_path(spark, "commented")
    nation = spark.read.parquet(f"{d}/nation.parquet")
    rows = F.concat(F.when(F.col("n_regionkey") == 0, "#").otherwise(""), F.concat_ws("|", "n_nationkey", "n_regionkey", "n_name"))
    nation.select(rows.alias("value")).write.text(path)
    return run(spark, f'r = read[file="{path}/part-*", mode="text", format="k INTEGER, region INTEGER, name VARCHAR", fieldSeparator="|", comment="#", output="name,k"];')


@query("SELECT 2 * i + 2 AS n, CAST(2 * i + 2 AS VARCHAR) || ' ' AS text FROM (SELECT unnest(range(5, 8)) AS i)")
def print_every(spark: SparkSession, d: str) -> DataFrame:
    """Of every second row, the first three that a predicate takes, as they are printed."""
    from rivulet.operators import shape

    said: list[str] = []
    shape.printed(shape.generate(spark, "RECORDCOUNT AS a, CAST(RECORDCOUNT AS VARCHAR) + ' ' AS t", 40), 3, 2, "a > 10LL", said.append)
    return spark.createDataFrame([(int(x.split("\t")[0]), x.split("\t")[1]) for x in said], "n long, text string")


@query("SELECT lower(o_orderstatus) AS folder, count(*) AS n, min(o_orderkey) AS low FROM orders GROUP BY 1")
def write_binary_dynamic(spark: SparkSession, d: str) -> DataFrame:
    """Rows written as Parquet to a folder for each status, counted by folder."""
    path = shared_path(spark, "statuses")
    graph(spark, f"""{tables(d, "orders")} w = write[connect="{path}", file="lower(o_orderstatus)", mode="binary", formatFile="{path}.format"]; orders -> w;""")
    return spark.read.parquet(path).groupBy(F.col("dir").alias("folder")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("low"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def write_parquet_read(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "finished")
    graph(spark, f"""{tables(d, "orders")} f = filter[where="o_orderstatus = 'F'"]; c = copy[output="o_orderkey, o_orderstatus"]; w = write[file="{path}"]; orders -> f; f -> c; c -> w;""")
    return run(spark, f'r = read[file="{path}"];')


@query("SELECT n_nationkey, n_name FROM nation")
def dev_null(spark: SparkSession, d: str) -> DataFrame:
    """One outlet is evaluated and dropped, the other goes on."""
    return run(spark, tables(d, "nation") + 'c = copy[output="n_nationkey, n_name", output="n_regionkey"]; x = devNull[]; p = copy[output="input.*"]; nation -> c; c -> p; c -> x;')


@query("SELECT r_regionkey, upper(reverse(r_name)) AS r_name FROM region")
def plug_in(spark: SparkSession, d: str) -> DataFrame:
    """An operator of the user's own."""
    from rivulet.operators.registry import register_operator
    from rivulet.operators.relation import Relation

    def mirrored(spark, node, inputs, n):
        r, name = inputs[0], node.get("field")
        return [Relation(r.df.withColumn(name, F.reverse(name)), r.fields, r.order)]

    register_operator("mirror", mirrored, ("field",))
    return run(spark, tables(d, "region") + 'm = mirror[field="r_name"]; c = copy[output="r_regionkey, upper(r_name) AS r_name"]; region -> m; m -> c;')


@query("SELECT o_custkey % 7 AS k, count(*) AS n, 1 AS parts FROM orders GROUP BY 1")
def hash_partitioned(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a key are in one partition."""
    from rivulet.operators import exchange
    from rivulet.operators.relation import of_dataframe

    r = of_dataframe(spark.read.parquet(f"{d}/orders.parquet").select((F.col("o_custkey") % 7).alias("k")))
    return exchange.hash_partition(r, 5, ["k"]).df.withColumn("part", F.spark_partition_id()).groupBy("k").agg(F.count("*").alias("n"), F.count_distinct("part").cast("int").alias("parts"))


@query("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def broadcast_partitioned(spark: SparkSession, d: str) -> DataFrame:
    from rivulet.operators import exchange, join
    from rivulet.operators.relation import of_dataframe

    nation, supplier = (of_dataframe(spark.read.parquet(f"{d}/{t}.parquet")) for t in ("nation", "supplier"))
    return join.join(exchange.to_all(nation), supplier, "inner", ["n_nationkey"], ["s_nationkey"], None, "s_suppkey, n_name").visible()


@query("SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
def collected(spark: SparkSession, d: str) -> DataFrame:
    """Partitions back together, in no order."""
    from rivulet.operators import exchange
    from rivulet.operators.relation import of_dataframe

    sides = [of_dataframe(spark.read.parquet(f"{d}/{t}.parquet").select(F.col(c).alias("name"))) for t, c in (("nation", "n_name"), ("region", "r_name"))]
    return exchange.collected([exchange.hash_partition(r, 3, ["name"]) for r in sides]).visible()


@query("SELECT n_nationkey AS a, n_regionkey AS b FROM nation WHERE n_regionkey IN (1, 3, 4)")
def organized_read(spark: SparkSession, d: str) -> DataFrame:
    """A table in folders by version, date and batch; a predicate on these prunes folders."""
    from rivulet.functions.types import parse_format
    from rivulet.sources.organized import read_organized

    path = shared_path(spark, "organized")
    nation = spark.read.parquet(f"{d}/nation.parquet")
    for k in range(5):
        rows = nation.where(F.col("n_regionkey") == k).select(F.concat_ws("\t", "n_nationkey", "n_regionkey").alias("value"))
        rows.coalesce(1).write.text(f"{path}/3_2/sales/5/{k % 2}/2024010{k + 1}/{k}/serial_00000")
    return read_organized(spark, path, 3, 2, "sales", 5, parse_format("a INTEGER, b INTEGER"), "MinorNumber = 1 OR Date = CAST('2024-01-05' AS DATE)").visible()


QUERIES["constant_rows"] = constant_rows
ORACLE_SQL["constant_rows"] = "SELECT 1 AS k, 'one' AS name UNION ALL SELECT 2, NULL"


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return QUERIES["flagship_pricing_summary"](spark, d)
