"""Rows and columns: generate, filter, copy, switch, unpivot, union_all, sort, sort_merge, print, devNull."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import islice

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from rivulet.functions import expressions as X
from rivulet.functions.types import Field, Type, Typed, common, converted
from rivulet.operators.relation import ORDER, Relation
from rivulet.plans.syntax import LanguageError


def generate(spark: SparkSession, output: str, rows: int = 10, partitions: int = 1) -> Relation:
    """`rows` rows for each partition, numbered from 0 there."""
    n = F.col("id")
    scope = X.Scope({"input": {
        "RECORDCOUNT": Typed(n % F.lit(rows) if partitions > 1 else n, Type("BIGINT")),
        "PARTITIONCOUNT": Typed(F.lit(partitions), Type("INTEGER")),
        "PARTITION": Typed((n / F.lit(rows)).cast("int") if partitions > 1 else F.lit(0), Type("INTEGER")),
    }})
    made = X.record(output, scope)
    df = spark.range(rows * partitions).select(*[c for _, c in made], n.alias(ORDER))
    return Relation(df, [f for f, _ in made], ((ORDER, True),))


def filter_rows(r: Relation, where: str | None = None, limit: int | None = None) -> Relation:
    """The rows where the predicate is true, and of those the first `limit` in the relation's order (any, where it has none)."""
    df = r.df.where(X.condition(where, r.scope())) if where else r.df
    if limit is not None:
        df = (df.orderBy(*r.ordering()) if r.order else df).limit(limit)
    return Relation(df, r.fields, r.order)


def copy(r: Relation, outputs: list[str]) -> list[Relation]:
    """One projection for each output."""
    return [r.select(X.record(o, r.scope())) for o in outputs]


def switch(r: Relation, on: str, n: int) -> list[Relation]:
    """n relations; a row goes where the expression's unsigned 32-bit value modulo n says, NULL to the first."""
    value = X.integer(X.value(on, r.scope()))
    if value.type.name != "INTEGER":
        raise LanguageError("switch needs an INTEGER")
    to = F.coalesce(F.pmod(F.pmod(value.column.cast("long"), F.lit(1 << 32)), F.lit(n)), F.lit(0))
    return [Relation(r.df.where(to == i), r.fields, r.order) for i in range(n)]


def unpivot(r: Relation, pattern: str, pivots: list[str], value: str) -> Relation:
    """A row for each column whose whole name matches: the pattern's groups (or the name) as pivot columns, the value, then the other columns."""
    hits = [(f, m) for f in r.fields if (m := re.fullmatch(pattern, f.name))]
    if not hits:
        raise LanguageError(f"no column matches {pattern}")
    if len(pivots) != max(1, re.compile(pattern).groups):
        raise LanguageError("pivotColumn is needed once for each group of the pattern")
    kind = reduce(common, (f.type for f, _ in hits))
    columns = r.columns()
    members = []
    for f, m in hits:
        labels = m.groups() or (f.name,)
        item = converted(Typed(columns[f.name], f.type), kind).column
        members.append(F.struct(*[F.lit(x).alias(f"p{i}") for i, x in enumerate(labels)], item.alias("v")))
    rest = [f for f in r.fields if f.name not in {h.name for h, _ in hits}]
    exploded = r.df.withColumn("__pivot", F.explode(F.array(*members)))
    made = [(Field(p, Type("VARCHAR")), F.col(f"__pivot.p{i}").alias(p)) for i, p in enumerate(pivots)]
    made += [(Field(value, kind), F.col("__pivot.v").alias(value))]
    made += [(f, columns[f.name]) for f in rest]
    return Relation(exploded, r.fields, ()).select(made)


def union_all(inputs: list[Relation], concatenate: bool = False) -> Relation:
    """All rows, by position, with the first input's names. concatenate: the inputs' order, one after another."""
    first = inputs[0]
    for r in inputs[1:]:
        if len(r.fields) != len(first.fields) or not all(a.type.same(b.type) for a, b in zip(first.fields, r.fields, strict=True)):
            raise LanguageError("the inputs of union_all differ in types")
    fields = [Field(f.name, f.type.null(any(r.fields[i].type.nullable for r in inputs))) for i, f in enumerate(first.fields)]
    ordered = concatenate and all(r.order == ((ORDER, True),) for r in inputs)
    parts = []
    for k, r in enumerate(inputs):
        own = [F.col(f"`{a}`").alias(b) for a, b in zip(r.names, first.names, strict=True)]
        parts.append(r.df.select(*own, *([F.lit(k).alias("__input"), F.col(ORDER)] if ordered else [])))
    df = reduce(lambda a, b: a.union(b), parts)
    return Relation(df, fields, (("__input", True), (ORDER, True)) if ordered else ())


def sort_key(text: str) -> tuple[str, bool]:
    m = re.fullmatch(r"\s*(\w+)(?:\s+(ASC|DESC))?\s*", text, re.I)
    if not m:
        raise LanguageError(f"bad sort key {text!r}")
    return m[1], (m[2] or "ASC").upper() == "ASC"


def sort(r: Relation, keys: list[str], presorted: list[str] = ()) -> Relation:  # type: ignore[assignment]
    """All rows in order; NULLs sort low. Rows that tie keep the order they had, where they had one."""
    order = [sort_key(k) for k in [*presorted, *keys]]
    for name, _ in order:
        r.field(name)
    own = {n for n, _ in order}
    out = Relation(r.df, r.fields, (*order, *[x for x in r.order if x[0] not in own]))
    return Relation(r.df.orderBy(*out.ordering()), r.fields, out.order)


def sort_merge(inputs: list[Relation], keys: list[str]) -> Relation:
    """The inputs' rows in one order."""
    return sort(union_all(inputs), keys)


def printed(r: Relation, n: int = 5, frequency: int = 1, where: str | None = None, write=print) -> Relation:
    """Prints up to n rows: of every frequency-th one in order (the first, the one `frequency` later, ...), those that the predicate takes. Passes all on.

    With a frequency, rows are streamed through the driver, partition after partition, until n are printed.
    """
    if frequency > 1:
        if not r.order:
            raise LanguageError("printFrequency needs rows in order")
        good = F.coalesce(X.condition(where, r.scope()), F.lit(False)) if where else F.lit(True)
        rows = r.df.orderBy(*r.ordering()).select(*[F.col(f"`{c}`") for c in r.names], good.alias("__good")).toLocalIterator()
        picked: Iterator | list = islice((x[:-1] for i, x in enumerate(rows) if i % frequency == 0 and x[-1]), n)
    else:
        picked = filter_rows(r, where, n).visible().collect()
    for x in picked:
        write("\t".join("\\N" if v is None else str(v) for v in x))
    return r


def dev_null(r: Relation) -> None:
    """Evaluates all rows and keeps none."""
    r.visible().write.format("noop").mode("overwrite").save()
