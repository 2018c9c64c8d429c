"""Partitioning of relations: by hash, to all, and back together. Graphs don't need these, as Spark shuffles where a plan needs it."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivulet.operators.relation import ORDER, Relation
from rivulet.operators.shape import union_all
from rivulet.sources.files import broadcast


def hash_partition(r: Relation, n: int, keys: list[str]) -> Relation:
    """The rows dealt out over n partitions, rows of equal keys to the same one."""
    return Relation(r.df.repartition(n, *[F.col(f"`{r.field(k).name}`") for k in keys]), r.fields, r.order)


def to_all(r: Relation) -> Relation:
    """The rows at every partition of a join's other side, where Spark's estimate of their size is within bounds."""
    return broadcast(r)


def collected(inputs: list[Relation]) -> Relation:
    """All rows of the inputs, in no order."""
    return union_all(inputs)


def concatenated(inputs: list[Relation]) -> Relation:
    """All rows of the inputs, one input after another, each in its order."""
    numbered = []
    for r in inputs:
        if r.order != ((ORDER, True),):
            ordered = r.df.orderBy(*r.ordering()).withColumn(ORDER, F.monotonically_increasing_id())
            r = Relation(ordered, r.fields, ((ORDER, True),))
        numbered.append(r)
    return union_all(numbered, True)
