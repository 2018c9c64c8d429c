"""Group by, running totals and folds.

Aggregates become one Spark aggregation, partial before the shuffle. Running totals are window
functions over ROWS UNBOUNDED PRECEDING, without keys in two levels over ranges of the order. Folds (initialize and update) are sequential by their
nature: rows are partitioned by key, sorted by key and order within partitions, and streamed
through the fold, so a group of any size takes the memory of one state.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from rivulet.functions import expressions as X
from rivulet.functions.fold import Fold
from rivulet.functions.types import Field
from rivulet.operators.relation import Relation, empty_scope
from rivulet.operators.shape import sort_key
from rivulet.plans.syntax import LanguageError
from rivulet.session import shared_path, ship


def _named(r: Relation, keys: list[str]) -> list[Column]:
    return [F.col(f"`{r.field(k).name}`") for k in keys]


def group_by(r: Relation, keys: list[str], output: str) -> Relation:
    """One row for each combination of keys, NULLs a group of their own; without keys one row, even of no rows."""
    made = X.record(output, r.scope(aggregates=True, keys=frozenset(keys)))
    columns = _named(r, keys)
    # keys are taken from the groups, so that the aggregation has no expression but the aggregates
    grouped = r.df.groupBy(*columns) if keys else r.df.groupBy()
    df = grouped.agg(*[c.alias(f"__out{i}") for i, (_, c) in enumerate(made)])
    return Relation(df.select(*[F.col(f"__out{i}").alias(f.name) for i, (f, _) in enumerate(made)]), [f for f, _ in made])


def _ordered(r: Relation, order_by: list[str]) -> Relation:
    return Relation(r.df, r.fields, tuple(sort_key(k) for k in order_by)) if order_by else r


def running(r: Relation, keys: list[str], output: str, order_by: list[str] = ()) -> Relation:  # type: ignore[assignment]
    """Each row with aggregates over the rows of its keys up to it. The order is orderBy, or that of the nearest sort."""
    r = _ordered(r, list(order_by))
    if not keys:
        return _running_of_all(r, output)
    over = Window.partitionBy(*_named(r, keys)).orderBy(*r.ordering()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return r.select(X.record(output, r.scope(aggregates=True, window=over)))


def _running_of_all(r: Relation, output: str) -> Relation:
    """A running total in two levels: within ranges of the order, and over the totals of the ranges before, a row for each range.

    The ranges are written first, as both levels must see the same ones.
    """
    spark, order = r.df.sparkSession, r.ordering()
    n, path = int(spark.conf.get("spark.sql.shuffle.partitions")), shared_path(spark, "ranges")
    ranged = r.df.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id())
    ranged.write.parquet(path)
    asked: list[tuple[str, Column]] = []

    def later(kind: str, argument: Column) -> Column:
        asked.append((kind, argument))
        return F.col(f"__total{len(asked) - 1}")

    made = X.record(output, r.scope(aggregates=True, window=later))
    of = {"SUM": F.sum, "MIN": F.min, "MAX": F.max}
    both = {"SUM": lambda a, b: F.coalesce(a + b, a, b), "MIN": F.least, "MAX": F.greatest}
    rows = spark.read.schema(ranged.schema).parquet(path).select("*", *[c.alias(f"__value{i}") for i, (_, c) in enumerate(asked)])
    totals = rows.groupBy("__range").agg(F.count("*").alias("__n"), *[of[k](f"__value{i}").alias(f"__all{i}") for i, (k, _) in enumerate(asked)])
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("__range", *[of[k](f"__all{i}").over(earlier).alias(f"__before{i}") for i, (k, _) in enumerate(asked)])
    within = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.join(F.broadcast(before), "__range")
    placed = placed.withColumns({f"__total{i}": both[k](F.col(f"__before{i}"), of[k](f"__value{i}").over(within)) for i, (k, _) in enumerate(asked)})
    return Relation(placed, r.fields, r.order).select(made)


def fold(r: Relation, keys: list[str], initialize: str, update: str, each: bool = False, order_by: list[str] = ()) -> Relation:  # type: ignore[assignment]
    """Keys and the state that `update` leaves after the rows of each group in order; each: after every row."""
    r = _ordered(r, list(order_by))
    state = [f for f, _ in X.record(initialize, empty_scope())]
    if clash := {f.name for f in state} & set(keys):
        raise LanguageError(f"state and keys share the names {sorted(clash)}")
    run = Fold(initialize, update, [f for f in r.fields if f.name not in {s.name for s in state}], state)
    fields = [r.field(k) for k in keys] + state
    spark = ship(r.df.sparkSession)
    group = _named(r, keys)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = r.df.repartition(n, *group) if group else r.df.coalesce(1)
    rows = placed.sortWithinPartitions(*group, *r.ordering())
    needed = [f for f in r.fields if f.name in run.reads or f.name in keys]
    schema = T.StructType([T.StructField(f.name, f.type.spark, True) for f in fields])
    width, at = len(keys), [f.name for f in needed]
    places = [at.index(k) for k in keys]

    def one(batches: Iterator) -> Iterator:
        import pyarrow as pa

        to = pa.schema([(f.name, _arrow(f)) for f in fields])
        now, state_, seen = None, None, False
        out: list[tuple] = []

        def flushed():
            table = pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), to, strict=True)], schema=to)
            out.clear()
            return table

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = tuple(row[i] for i in places)
                if not seen or key != now:
                    if seen and not each:
                        out.append((*now, *run.result(state_)))  # type: ignore[misc]
                    now, state_, seen = key, run.start(), True
                run.step(state_, dict(zip(at, row, strict=True)))
                if each:
                    out.append((*key, *run.result(state_)))
            if out:
                yield flushed()
        if not each and (seen or not width):
            out.append((*(now or ()), *run.result(state_ if seen else run.start())))
        if out:
            yield flushed()

    df: DataFrame = rows.select(*[F.col(f"`{x}`") for x in at] or [F.lit(1).alias("__one")]).mapInArrow(one, schema)
    return Relation(df, fields)


def _arrow(f: Field):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(f.type.spark)
