"""A relation: a DataFrame, its fields in the language's types, and the order of its rows where it has one.

Spark keeps no order of rows, so operators that depend on it (running totals, folds) need sort
columns. Sources that have an order carry a hidden column for it, ORDER, which Catalyst prunes
when nothing asks for it; sort and sort_merge set the order to their keys.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.functions.expressions import Scope, scope_of
from rivulet.functions.types import Field, literal_null, of_spark
from rivulet.plans.syntax import LanguageError

ORDER = "__order"


@dataclass(frozen=True)
class Relation:
    df: DataFrame
    fields: list[Field]
    order: tuple[tuple[str, bool], ...] = field(default=())  # columns, ascending?

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    @property
    def hidden(self) -> list[str]:
        return [c for c in self.df.columns if c.startswith("__")]

    def columns(self, alias: str | None = None) -> dict[str, Column]:
        return {n: F.col(f"{alias}.`{n}`" if alias else f"`{n}`") for n in self.names}

    def scope(self, alias: str = "input", **more) -> Scope:
        return scope_of({alias: (self.fields, self.columns())}, **more)

    def select(self, made: list[tuple[Field, Column]]) -> Relation:
        """The made fields. Order columns stay, hidden where the output lacks them."""
        kept, order = [], []
        own = {f.name for f, _ in made}
        for name, up in self.order:
            hidden = name if name.startswith("__") else f"__{name}"
            if hidden not in own and hidden not in [h for h, _ in kept]:
                kept.append((hidden, F.col(f"`{name}`").alias(hidden)))
            order.append((hidden, up))
        return Relation(self.df.select(*[c for _, c in made], *[c for _, c in kept]), [f for f, _ in made], tuple(order))

    def ordering(self) -> list[Column]:
        if not self.order:
            raise LanguageError("the rows have no order: sort them first, or name the order with orderBy")
        return [F.col(f"`{c}`").asc_nulls_first() if up else F.col(f"`{c}`").desc_nulls_last() for c, up in self.order]

    def visible(self) -> DataFrame:
        return self.df.select(*[F.col(f"`{n}`") for n in self.names])

    def field(self, name: str) -> Field:
        for f in self.fields:
            if f.name == name:
                return f
        raise LanguageError(f"unknown field {name}")


def of_dataframe(df: DataFrame) -> Relation:
    """A DataFrame as a relation: columns are cast to the types of the language."""
    fields = of_spark(df.schema)
    return Relation(df.select(*[F.col(f"`{f.name}`").cast(f.type.spark).alias(f.name) for f in fields]), fields)


def empty_scope() -> Scope:
    return Scope({})


def null_column(f: Field) -> Column:
    return literal_null(f.type).alias(f.name)
