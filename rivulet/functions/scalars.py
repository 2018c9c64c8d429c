"""Casts, intervals and the named functions, as Spark columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from rivulet.functions.types import NUMERIC, SPARK, Type, Typed, common, converted
from rivulet.plans.syntax import LanguageError

SPACE = " \t\n\r\f\x0b"
EASTERN = "America/New_York"
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def digits(text: Column, kind: str) -> Column:
    """The leading whole number of a text, else 0, as C's atoi reads it; numbers beyond the type's range are 0."""
    return F.coalesce(F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast(SPARK[kind]), F.lit(0).cast(SPARK[kind]))


def padded(text: Column, size: int) -> Column:
    return F.rpad(F.substring(text, 1, size), size, " ")


def as_text(x: Typed) -> Column:
    kind = x.type.name
    if kind == "DOUBLE":
        plain = F.format_string("%.15g", x.column)
        # %g of C has no zeros after the last digit
        return F.when(x.column.isNull(), None).otherwise(F.regexp_replace(F.regexp_replace(plain, r"(\.\d*?)0+(?=$|e)", "$1"), r"\.(?=$|e)", ""))
    if kind == "DECIMAL":
        return F.regexp_replace(F.regexp_replace(x.column.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    if kind == "DATETIME":
        return F.date_format(x.column, "yyyy-MM-dd HH:mm:ss")
    if kind == "DATE":
        return F.date_format(x.column, "yyyy-MM-dd")
    if kind == "BOOLEAN":
        return x.column.cast("int").cast("string")
    return x.column.cast("string")


def cast(x: Typed, to: Type) -> Typed:
    a, b, c = x.type.name, to.name, x.column
    out = to.null(x.type.nullable or a == "NIL")
    if a == "NIL":
        return Typed(c.cast(to.spark), out)
    if b in ("VARCHAR", "CHAR"):
        text = as_text(x)
        return Typed(padded(text, int(to.size)) if b == "CHAR" else text, out, x.raises, x.aggregate)  # type: ignore[arg-type]
    text = a in ("CHAR", "VARCHAR")
    if b in ("INTEGER", "BIGINT"):
        if text:
            column = digits(c, b)
        elif a == "DECIMAL":
            column = F.bround(c, 0).cast(to.spark)
        elif a == "DATE" or a == "DATETIME":
            shape = "yyyyMMddHHmmss" if a == "DATETIME" and b == "BIGINT" else "yyyyMMdd"
            column = F.date_format(c, shape).cast(to.spark)
        elif a in ("BIGINT", "INTEGER") and b == "INTEGER":
            # the low 32 bits, as an assignment keeps them
            column = c if a == "INTEGER" else (F.pmod(c + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)).cast("int")
        else:
            column = c.cast(to.spark)
    elif b in ("DOUBLE", "DECIMAL"):
        if a in ("DATE", "DATETIME"):
            column = F.date_format(c, "yyyyMMddHHmmss" if a == "DATETIME" else "yyyyMMdd").cast(to.spark)
        elif text:
            column = F.coalesce(F.regexp_extract(c, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast(to.spark), F.lit(0).cast(to.spark))
        else:
            column = c.cast(to.spark)
        if text:
            column = F.when(c.isNotNull(), column)
    elif b == "DATE" and (text or a == "DATE"):
        column = c.cast("date")
    elif b == "DATETIME" and (text or a in ("DATE", "DATETIME")):
        column = c.cast("timestamp_ntz")
    elif b == "BOOLEAN" and a in ("INTEGER", "BOOLEAN"):
        column = c if a == "BOOLEAN" else c != 0
    else:
        raise LanguageError(f"no cast of {x.type} to {to}")
    if text and b in ("INTEGER", "BIGINT"):
        column = F.when(c.isNotNull(), column)
    return Typed(column, out, True, x.aggregate)


def add_interval(x: Typed, n: Typed, sign: int) -> Typed:
    """A date or datetime and an interval. Ends of months stay ends of months; hours, minutes and seconds make a date a datetime."""
    unit, count = str(n.type.size), n.column * sign
    nullable = x.type.nullable or n.type.nullable
    if unit in ("MONTH", "YEAR"):
        months = count * 12 if unit == "YEAR" else count
        day = x.column.cast("date") if x.type.name == "DATETIME" else x.column
        moved = F.add_months(day, months)
        moved = F.when(day == F.last_day(day), F.last_day(moved)).otherwise(moved)
        if x.type.name == "DATETIME":
            moved = moved.cast("timestamp_ntz") + (x.column - day.cast("timestamp_ntz"))
        return Typed(moved, x.type.null(nullable), True)
    if unit == "DAY" and x.type.name == "DATE":
        return Typed(F.date_add(x.column, count), x.type.null(nullable), True)
    zero = F.lit(0)
    parts = [count if unit == u else zero for u in ("DAY", "HOUR", "MINUTE")]
    step = F.make_dt_interval(*parts, (count if unit == "SECOND" else zero).cast("decimal(18,6)"))
    return Typed(x.column.cast("timestamp_ntz") + step, Type("DATETIME", nullable), True)


#: name: argument types, result type, column of the columns.
FUNCTIONS: dict[str, tuple[tuple[str, ...], str, Callable[..., Column]]] = {
    "ceil": (("DOUBLE",), "DOUBLE", lambda x: F.ceil(x).cast("double")),
    "floor": (("DOUBLE",), "DOUBLE", lambda x: F.floor(x).cast("double")),
    "sqrt": (("DOUBLE",), "DOUBLE", F.sqrt),
    "log": (("DOUBLE",), "DOUBLE", lambda x: F.when(x > 0, F.ln(x)).when(x == 0, F.lit(float("-inf"))).when(x.isNotNull(), F.lit(float("nan")))),
    "exp": (("DOUBLE",), "DOUBLE", F.exp),
    "length": (("VARCHAR",), "INTEGER", F.octet_length),
    "trim": (("VARCHAR",), "VARCHAR", lambda s: F.btrim(s, F.lit(SPACE))),
    "ltrim": (("VARCHAR",), "VARCHAR", lambda s: F.ltrim(s, F.lit(SPACE))),
    "rtrim": (("VARCHAR",), "VARCHAR", lambda s: F.rtrim(s, F.lit(SPACE))),
    "lower": (("VARCHAR",), "VARCHAR", lambda s: F.translate(s, UPPER, LOWER)),
    "upper": (("VARCHAR",), "VARCHAR", lambda s: F.translate(s, LOWER, UPPER)),
    "md5": (("VARCHAR",), "VARCHAR", lambda s: F.md5(s.cast("binary"))),
    "substr": (("VARCHAR", "INTEGER", "INTEGER"), "VARCHAR", lambda s, a, n: F.substring(s.cast("binary"), a + 1, F.when(n < 0, F.octet_length(s)).otherwise(n)).cast("string")),
    "utc_timestamp": ((), "DATETIME", lambda: F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()).cast("timestamp_ntz")),
    "unix_timestamp": (("DATETIME",), "BIGINT", lambda t: F.unix_seconds(F.make_timestamp(F.year(t), F.month(t), F.dayofmonth(t), F.hour(t), F.minute(t), F.second(t).cast("decimal(8,6)"), F.lit(EASTERN)))),
    "from_unixtime": (("BIGINT",), "DATETIME", lambda x: F.convert_timezone(F.current_timezone(), F.lit(EASTERN), F.timestamp_seconds(x).cast("timestamp_ntz"))),
    "date": (("DATETIME",), "DATE", F.to_date),
    "dayofweek": (("DATE",), "INTEGER", F.dayofweek),
    "dayofmonth": (("DATE",), "INTEGER", F.dayofmonth),
    "dayofyear": (("DATE",), "INTEGER", F.dayofyear),
    "month": (("DATE",), "INTEGER", F.month),
    "year": (("DATE",), "INTEGER", F.year),
    "last_day": (("DATE",), "DATE", F.last_day),
    "datediff": (("DATE", "DATE"), "INTEGER", F.datediff),
    "julian_day": (("DATE",), "INTEGER", lambda d: F.datediff(d, F.lit("1970-01-01").cast("date")) + 2440588),
}
#: Names that no output field may have.
RESERVED = frozenset((*FUNCTIONS, "round", "least", "greatest", "isnull", "ifnull"))


def _round(x: Typed, n: Typed, scale: int | None) -> Column:
    if scale is None:
        raise LanguageError("round needs a literal number of digits")
    return F.bround(x.column, scale)


def call(name: str, args: list[Typed], literals: list[object]) -> Typed:
    """A named function; least, greatest, isnull and ifnull in any case of letters."""
    raises, aggregate = any(a.raises for a in args), any(a.aggregate for a in args)
    low = name.lower()
    if low in ("isnull", "ifnull"):
        if len(args) != 2:
            raise LanguageError(f"{name} takes a value and what stands for NULL")
        kind = common(args[0].type, args[1].type).null(args[1].type.nullable)
        return Typed(F.coalesce(*[converted(a, kind).column for a in args]), kind, raises, aggregate)
    if low in ("least", "greatest"):
        if not args:
            raise LanguageError(f"{name} takes at least one value")
        out = args[0]
        for b in args[1:]:
            kind = common(out.type, b.type)
            x, y = converted(out, kind).column, converted(b, kind).column
            out = Typed(F.when(x < y if low == "least" else x > y, x).otherwise(y), kind)
        return Typed(out.column, out.type, raises, aggregate)
    if name == "round":
        if len(args) != 2:
            raise LanguageError("round takes a value and a number of digits")
        value = converted(args[0], Type("DECIMAL"))
        scale = literals[1] if isinstance(literals[1], int) else None
        return Typed(_round(value, args[1], scale).cast(SPARK["DECIMAL"]), Type("DECIMAL", value.type.nullable), raises, aggregate)
    if name not in FUNCTIONS:
        raise LanguageError(f"unknown function {name}")
    wanted, result, make = FUNCTIONS[name]
    if len(args) != len(wanted):
        raise LanguageError(f"{name} takes {len(wanted)} arguments")
    columns = [converted(a, Type(w)).column for a, w in zip(args, wanted, strict=True)]
    nullable = any(a.type.nullable for a in args)
    return Typed(make(*columns), Type(result, nullable), raises or bool(set(wanted) & {"DOUBLE"}) and name in ("ceil", "floor"), aggregate)


def is_numeric(kind: Type) -> bool:
    return kind.name in NUMERIC or kind.name == "BOOLEAN"
