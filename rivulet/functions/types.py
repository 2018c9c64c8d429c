"""The language's types, their conversions, and format strings.

DECIMAL is decimal(28, 9): Spark's scale belongs to the column, so a value's own number of
digits after the point is not kept. BOOLEAN stays boolean inside expressions and becomes an
integer, 0 or 1, where it is a field, is compared with a number or counted.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.plans.syntax import LanguageError, Parser

PRECISION, SCALE = 28, 9
NUMERIC = ("INTEGER", "BIGINT", "DECIMAL", "DOUBLE")
SPARK = {
    "INTEGER": T.IntegerType(),
    "BIGINT": T.LongType(),
    "DOUBLE": T.DoubleType(),
    "DECIMAL": T.DecimalType(PRECISION, SCALE),
    "CHAR": T.StringType(),
    "VARCHAR": T.StringType(),
    "DATETIME": T.TimestampNTZType(),
    "DATE": T.DateType(),
    "BOOLEAN": T.BooleanType(),
    "NIL": T.NullType(),
}


@dataclass(frozen=True)
class Type:
    """name is a key of SPARK, INTERVAL (size: its unit) or ARRAY (element: the members' type)."""

    name: str
    nullable: bool = False
    size: int | str | None = None
    element: Type | None = None

    def null(self, nullable: bool = True) -> Type:
        return replace(self, nullable=nullable)

    def __str__(self) -> str:
        return f"CHAR({self.size})" if self.name == "CHAR" else "DOUBLE PRECISION" if self.name == "DOUBLE" else self.name

    def same(self, other: Type) -> bool:
        return replace(self, nullable=False) == replace(other, nullable=False)

    @property
    def spark(self) -> T.DataType:
        if self.name == "ARRAY":
            return T.ArrayType(self.element.spark, False)  # type: ignore[union-attr]
        return SPARK["INTEGER"] if self.name == "INTERVAL" else SPARK[self.name]


@dataclass(frozen=True)
class Typed:
    """A Spark column with its type in the language. raises: evaluating it can end the query (division, casts). aggregate: it holds an aggregate."""

    column: Column
    type: Type
    raises: bool = False
    aggregate: bool = False


def widens(a: Type, b: Type) -> bool:
    """Whether a becomes b by itself."""
    if a.name == "NIL" or replace(a, nullable=False) == replace(b, nullable=False):
        return True
    if a.name == "BOOLEAN" and b.name in NUMERIC:
        return True
    if a.name == "INTEGER" and b.name == "BOOLEAN":
        return True
    if a.name in NUMERIC and b.name in NUMERIC:
        return NUMERIC.index(a.name) <= NUMERIC.index(b.name)
    if a.name == "ARRAY" and b.name == "ARRAY":
        return widens(a.element, b.element)  # type: ignore[arg-type]
    return a.name == "CHAR" and b.name == "VARCHAR"


def common(a: Type, b: Type) -> Type:
    nullable = a.nullable or b.nullable or "NIL" in (a.name, b.name)
    if a.name == "BOOLEAN" and b.name == "INTEGER" or a.name == "INTEGER" and b.name == "BOOLEAN":
        return Type("INTEGER", nullable)
    if a.name == b.name == "CHAR" and a.size != b.size:
        return Type("VARCHAR", nullable)
    if widens(a, b):
        return b.null(nullable)
    if widens(b, a):
        return a.null(nullable)
    raise LanguageError(f"no common type of {a} and {b}")


def converted(x: Typed, to: Type) -> Typed:
    """x in a type that it widens to."""
    if not widens(x.type, to):
        raise LanguageError(f"{x.type} does not become {to} by itself")
    if x.type.name == to.name and x.type.name != "NIL":
        return x
    if to.name == "BOOLEAN":
        column = x.column != 0
    elif to.name == "INTERVAL":
        column = x.column
    else:
        column = x.column.cast(to.spark)
    return replace(x, column=column, type=to.null(x.type.nullable or x.type.name == "NIL"))


def declared(kind: tuple[str, int | None], nullable: bool = False) -> Type:
    """A type as the parser gives it. BOOLEAN fields are integers."""
    return Type("INTEGER" if kind[0] == "BOOLEAN" else kind[0], nullable, kind[1])


@dataclass(frozen=True)
class Field:
    name: str
    type: Type


def parse_format(text: str) -> list[Field]:
    return [Field(name, declared(kind, nullable)) for name, kind, nullable in Parser(text).format()]


def print_format(fields: list[Field]) -> str:
    return ",".join(f"{f.name} {f.type}{' NULL' if f.type.nullable else ''}" for f in fields)


def of_spark(schema: T.StructType) -> list[Field]:
    """Fields of a DataFrame; small numbers widen, text is VARCHAR."""

    def one(kind: T.DataType, nullable: bool) -> Type:
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
            return Type("INTEGER", nullable)
        if isinstance(kind, T.LongType):
            return Type("BIGINT", nullable)
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            return Type("DOUBLE", nullable)
        if isinstance(kind, T.DecimalType):
            return Type("DECIMAL", nullable)
        if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
            return Type("DATETIME", nullable)
        if isinstance(kind, T.DateType):
            return Type("DATE", nullable)
        if isinstance(kind, T.BooleanType):
            return Type("INTEGER", nullable)
        if isinstance(kind, T.ArrayType):
            return Type("ARRAY", nullable, None, one(kind.elementType, False))
        return Type("VARCHAR", nullable)

    return [Field(f.name, one(f.dataType, f.nullable)) for f in schema.fields]


def literal_null(kind: Type) -> Column:
    return F.lit(None).cast(kind.spark)
