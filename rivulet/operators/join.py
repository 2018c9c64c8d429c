"""Joins. Hash joins read a table and probe it, merge joins have a left and a right side; both are one function.

Spark picks the physical join by the sides' sizes. A hash join asks for a shuffled hash join, and
for a broadcast of its table only where Spark's own estimate of the table's size is within
BROADCAST_BYTES; a merge join asks for a sort-merge join, which spills.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from rivulet.functions import expressions as X
from rivulet.functions.types import Field, Typed, common, converted
from rivulet.operators.relation import Relation
from rivulet.plans.syntax import LanguageError

BROADCAST_BYTES = 32 << 20
KINDS = ("inner", "left_outer", "right_outer", "full_outer", "right_semi", "right_anti_semi")
_SPARK = {"inner": "inner", "left_outer": "left", "right_outer": "right", "full_outer": "full", "right_semi": "left_semi", "right_anti_semi": "left_anti"}


def estimated_bytes(r: Relation) -> int:
    """Spark's estimate after pruning and pushdown; of files, their size."""
    return int(r.df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def join(first: Relation, second: Relation, kind: str, first_keys: list[str], second_keys: list[str], residual: str | None = None, output: str | None = None, aliases: tuple[str, str] = ("table", "probe"), strategy: str = "hash") -> Relation:
    """first is the table or left side. The residual is part of the condition that decides what matches. NULL keys match nothing.

    Semi and anti joins give rows of the second side alone, under the alias `input` or its own.
    """
    if kind not in KINDS:
        raise LanguageError(f"unknown join {kind}")
    if len(first_keys) != len(second_keys):
        raise LanguageError("the sides' keys differ in number")
    a, b = aliases
    names = {a: [f"__{a}_{i}" for i in range(len(first.fields))], b: [f"__{b}_{i}" for i in range(len(second.fields))]}
    sides, columns = {}, {}
    for alias, r in ((a, first), (b, second)):
        sides[alias] = r.df.select(*[F.col(f"`{n}`").alias(x) for n, x in zip(r.names, names[alias], strict=True)])
        columns[alias] = {n: F.col(x) for n, x in zip(r.names, names[alias], strict=True)}
    parts: list[Column] = []
    for m, n in zip(first_keys, second_keys, strict=True):
        f, g = first.field(m), second.field(n)
        both = common(f.type, g.type)
        parts.append(converted(Typed(columns[a][m], f.type), both).column == converted(Typed(columns[b][n], g.type), both).column)
    scope = X.scope_of({a: (first.fields, columns[a]), b: (second.fields, columns[b])})
    if residual:
        parts.append(X.condition(residual, scope))
    one_sided = kind in ("right_semi", "right_anti_semi")
    if not first_keys and kind != "inner":
        raise LanguageError("a join without keys is an inner join")
    left, right = (sides[b], sides[a]) if one_sided else (sides[a], sides[b])
    if first_keys:
        if strategy == "merge":
            left = left.hint("merge")
        elif estimated_bytes(first) <= BROADCAST_BYTES and kind in ("inner", "right_outer", "right_semi", "right_anti_semi"):
            left, right = (left, F.broadcast(right)) if one_sided else (F.broadcast(left), right)
        else:
            left, right = (left, right.hint("shuffle_hash")) if one_sided else (left.hint("shuffle_hash"), right)
    if parts:
        df = left.join(right, reduce(lambda x, y: x & y, parts), _SPARK[kind])
    else:
        df = left.crossJoin(right)
    loose = {a: kind in ("right_outer", "full_outer"), b: kind in ("left_outer", "full_outer")}
    fields = {alias: [Field(f.name, f.type.null(f.type.nullable or loose[alias])) for f in r.fields] for alias, r in ((a, first), (b, second))}
    if one_sided:
        scope = X.Scope({"input": X.scope_of({b: (fields[b], columns[b])}).fields[b]})
        made = X.record(output or "input.*", scope) if output is None or f"{b}." not in output else X.record(output, X.scope_of({b: (fields[b], columns[b])}))
    elif output:
        made = X.record(output, X.scope_of({x: (fields[x], columns[x]) for x in (a, b)}))
    else:
        made = [(f, columns[x][f.name].alias(f.name)) for x in (a, b) for f in fields[x]]
        seen = [f.name for f, _ in made]
        if len(set(seen)) < len(seen):
            raise LanguageError("the sides share field names: name the output")
    return Relation(df.select(*[c for _, c in made]), [f for f, _ in made])
