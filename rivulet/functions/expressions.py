"""Type-checks expressions and makes Spark columns of them, so that Catalyst sees all of a graph.

Where the language differs from SQL, the column says so: AND and OR evaluate left to right and
treat a NULL on the left as false, whole numbers divide toward zero, sums keep their argument's
type, regular expressions match whole texts, dates at the end of a month stay there.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from rivulet.functions import scalars
from rivulet.functions.types import SPARK, Field, Type, Typed, common, converted, declared
from rivulet.plans.syntax import LanguageError, Node, Parser


@dataclass
class Scope:
    """What names mean: fields by alias, and locals. keys: where not None, the only names that are seen outside of aggregates. window: aggregates run over it, or are the columns that it gives for their names and arguments."""

    fields: dict[str, dict[str, Typed]]
    locals: dict[str, Typed] = field(default_factory=dict)
    aggregates: bool = False
    keys: frozenset[str] | None = None
    window: WindowSpec | Callable[[str, Column], Column] | None = None
    inside: bool = False

    def find(self, alias: str | None, name: str) -> Typed:
        if alias is None and name in self.locals:
            return self.locals[name]
        if alias is not None:
            found = [self.fields[alias][name]] if name in self.fields.get(alias, {}) else []
        else:
            found = [f[name] for f in self.fields.values() if name in f]
        if not found:
            raise LanguageError(f"unknown variable {name if alias is None else f'{alias}.{name}'}")
        if len(found) > 1:
            raise LanguageError(f"ambiguous variable reference {name}")
        if self.keys is not None and not self.inside and name not in self.keys:
            raise LanguageError(f"{name} is not a key: it must be inside an aggregate")
        return found[0]


def integer(x: Typed) -> Typed:
    return replace(x, column=x.column.cast("int"), type=Type("INTEGER", x.type.nullable)) if x.type.name == "BOOLEAN" else x


def boolean(x: Typed) -> Typed:
    if x.type.name in ("BOOLEAN", "NIL"):
        return replace(x, column=x.column.cast("boolean"), type=Type("BOOLEAN", x.type.nullable or x.type.name == "NIL"))
    if x.type.name == "INTEGER":
        return replace(x, column=x.column != 0, type=Type("BOOLEAN", x.type.nullable))
    raise LanguageError(f"{x.type} is no condition")


def compile_node(n: Node, s: Scope) -> Typed:
    return globals()[f"_{n.kind}"](n, s)


def _all(args, s: Scope) -> list[Typed]:
    return [compile_node(a, s) for a in args]


def _mixed(*parts: Typed) -> dict:
    return {"raises": any(p.raises for p in parts), "aggregate": any(p.aggregate for p in parts)}


def _literal(n: Node, s: Scope) -> Typed:
    kind, value = n.args[0], n.value
    if kind == "string":
        return Typed(F.lit(value), Type("VARCHAR"))
    if kind == "int":
        return Typed(F.lit(value).cast("int"), Type("INTEGER"))
    if kind == "bigint":
        return Typed(F.lit(value).cast("long"), Type("BIGINT"))
    if kind == "decimal":
        return Typed(F.lit(Decimal(value)).cast(SPARK["DECIMAL"]), Type("DECIMAL"))  # type: ignore[arg-type]
    return Typed(F.lit(value), Type("DOUBLE"))


def _boolean(n: Node, s: Scope) -> Typed:
    return Typed(F.lit(n.value), Type("BOOLEAN"))


def _null(n: Node, s: Scope) -> Typed:
    return Typed(F.lit(None), Type("NIL", True))


def _column(n: Node, s: Scope) -> Typed:
    return s.find(*n.value)  # type: ignore[misc]


def _and(n: Node, s: Scope) -> Typed:
    a, b = map(boolean, _all(n.args, s))
    return Typed(F.when(a.column, b.column).otherwise(F.lit(False)), Type("BOOLEAN", b.type.nullable), **_mixed(a, b))


def _or(n: Node, s: Scope) -> Typed:
    a, b = map(boolean, _all(n.args, s))
    return Typed(F.when(a.column, F.lit(True)).otherwise(b.column), Type("BOOLEAN", b.type.nullable), **_mixed(a, b))


def _not(n: Node, s: Scope) -> Typed:
    a = boolean(compile_node(n.args[0], s))
    return replace(a, column=~a.column)


def _isnull(n: Node, s: Scope) -> Typed:
    a = compile_node(n.args[0], s)
    return Typed(a.column.isNull() if n.value else a.column.isNotNull(), Type("BOOLEAN"), **_mixed(a))


def _choice(n: Node, s: Scope) -> Typed:
    c, a, b = _all(n.args, s)
    c = boolean(c)
    if c.type.nullable:
        raise LanguageError("the condition of ?: must not be nullable")
    kind = common(a.type, b.type)
    return Typed(F.when(c.column, converted(a, kind).column).otherwise(converted(b, kind).column), kind, **_mixed(a, b, c))


def _case(n: Node, s: Scope) -> Typed:
    arms, other = n.args
    conds = [boolean(compile_node(w, s)) for w, _ in arms]
    values = [compile_node(t, s) for _, t in arms]
    last = compile_node(other, s)
    kind = last.type
    for v in values:
        kind = common(kind, v.type)
    out: Column | None = None
    for c, v in zip(conds, values, strict=True):
        column = converted(v, kind).column if kind.name != "NIL" else v.column
        out = F.when(c.column, column) if out is None else out.when(c.column, column)
    return Typed(out.otherwise(converted(last, kind).column if kind.name != "NIL" else last.column), kind, **_mixed(*conds, *values, last))  # type: ignore[union-attr]


def _unary(n: Node, s: Scope) -> Typed:
    x = integer(compile_node(n.args[0], s))
    if not scalars.is_numeric(x.type) or n.value == "~" and x.type.name not in ("INTEGER", "BIGINT"):
        raise LanguageError(f"{n.value} does not take {x.type}")
    return x if n.value == "+" else replace(x, column=-x.column if n.value == "-" else F.bitwise_not(x.column), raises=x.raises or n.value == "-")


def _binary(n: Node, s: Scope) -> Typed:
    op = str(n.value)
    a, b = _all(n.args, s)
    if op in ("LIKE", "RLIKE"):
        return _matches(op, n.args[1], a, b)
    if op in ("=", "<>", "<", ">", "<=", ">="):
        kind = common(a.type, b.type)
        if kind.name == "ARRAY":
            raise LanguageError("arrays are not compared")
        x, y = (converted(v, kind).column if kind.name != "NIL" else v.column for v in (a, b))
        got = {"=": x == y, "<>": x != y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op]
        return Typed(got, Type("BOOLEAN", kind.nullable), **_mixed(a, b))
    if op in "+-" and "INTERVAL" in (a.type.name, b.type.name):
        if a.type.name == "INTERVAL" and op == "+":
            a, b = b, a
        if a.type.name not in ("DATE", "DATETIME") or b.type.name != "INTERVAL":
            raise LanguageError(f"no {op} of {a.type} and {b.type}")
        return replace(scalars.add_interval(a, b, 1 if op == "+" else -1), aggregate=a.aggregate or b.aggregate)
    if op == "+" and a.type.name in ("CHAR", "VARCHAR") and b.type.name in ("CHAR", "VARCHAR"):
        both = a.type.name == b.type.name == "CHAR"
        nullable = a.type.nullable or b.type.nullable
        kind = Type("CHAR", nullable, int(a.type.size) + int(b.type.size)) if both else Type("VARCHAR", nullable)  # type: ignore[arg-type]
        return Typed(F.concat(a.column, b.column), kind, **_mixed(a, b))
    a, b = integer(a), integer(b)
    kind = common(a.type, b.type)
    if not scalars.is_numeric(kind) and kind.name != "NIL":
        raise LanguageError(f"no {op} of {a.type} and {b.type}")
    if op in "%&|^" and kind.name not in ("INTEGER", "BIGINT"):
        raise LanguageError(f"{op} takes whole numbers")
    x, y = converted(a, kind).column, converted(b, kind).column
    if op == "/":
        got = F.call_function("div", x, y) if kind.name in ("INTEGER", "BIGINT") else x / y
    else:
        got = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "%": lambda: x % y, "&": lambda: x.bitwiseAND(y), "|": lambda: x.bitwiseOR(y), "^": lambda: x.bitwiseXOR(y)}[op]()
    if op == "/" and kind.name == "INTEGER" or kind.name == "DECIMAL":
        got = got.cast(SPARK[kind.name])
    return Typed(got, kind, _mixed(a, b)["raises"] or op not in "&|^", a.aggregate or b.aggregate)


def _matches(op: str, pattern: Node, a: Typed, b: Typed) -> Typed:
    if op == "LIKE":
        raise LanguageError("LIKE is not implemented")
    for x in (a, b):
        if x.type.name not in ("VARCHAR", "CHAR"):
            raise LanguageError("RLIKE takes texts")
    whole = F.lit(rf"\A(?:{pattern.value})\z") if pattern.kind == "literal" else F.concat(F.lit(r"\A(?:"), b.column, F.lit(r")\z"))
    return Typed(F.rlike(a.column, whole), Type("BOOLEAN", a.type.nullable or b.type.nullable), **_mixed(a, b))


def _cast(n: Node, s: Scope) -> Typed:
    name, size = n.value  # type: ignore[misc]
    x = compile_node(n.args[0], s)
    return scalars.cast(x, Type("BOOLEAN") if name == "BOOLEAN" else declared((name, size)))


def _interval(n: Node, s: Scope) -> Typed:
    if n.value not in ("DAY", "HOUR", "MINUTE", "MONTH", "SECOND", "YEAR"):
        raise LanguageError(f"unknown interval unit {n.value}")
    x = integer(compile_node(n.args[0], s))
    if x.type.name != "INTEGER":
        raise LanguageError("an interval counts in INTEGER")
    return replace(x, type=Type("INTERVAL", x.type.nullable, str(n.value)))


def _array(n: Node, s: Scope) -> Typed:
    items = _all(n.args, s)
    if not items:
        raise LanguageError("an array needs a member")
    kind = items[0].type
    for x in items[1:]:
        kind = common(kind, x.type)
    if kind.nullable:
        raise LanguageError("members of an array must not be nullable")
    return Typed(F.array(*[converted(x, kind).column for x in items]), Type("ARRAY", False, None, kind), **_mixed(*items))


def _index(n: Node, s: Scope) -> Typed:
    a, i = _all(n.args, s)
    if a.type.name != "ARRAY" or i.type.name not in ("INTEGER", "BIGINT"):
        raise LanguageError("only arrays are indexed, by whole numbers")
    return Typed(a.column[i.column], a.type.element.null(a.type.nullable or i.type.nullable), True, a.aggregate)  # type: ignore[union-attr]


def _hash(n: Node, s: Scope) -> Typed:
    items = _all(n.args, s)
    return Typed(F.hash(*[x.column for x in items]), Type("INTEGER"), **_mixed(*items))


def _prefix(n: Node, s: Scope) -> Typed:
    (x,) = _all(n.args, s)
    if x.type.name not in ("INTEGER", "BIGINT"):
        raise LanguageError("$ takes a whole number")
    wide = x.column.cast("long")
    got = F.shiftright(wide + F.lit(1 << 31), 1) if x.type.name == "INTEGER" else F.shiftrightunsigned(wide.bitwiseXOR(F.lit(-(1 << 63))), 33)
    return Typed(got.cast("int"), Type("INTEGER", x.type.nullable), **_mixed(x))


def _call(n: Node, s: Scope) -> Typed:
    args = _all(n.args, s)
    return scalars.call(str(n.value), [integer(a) for a in args], [a.value if a.kind == "literal" else None for a in n.args])


def _aggregate(n: Node, s: Scope) -> Typed:
    if not s.aggregates:
        raise LanguageError(f"{n.value} outside of a group by")
    if s.inside:
        raise LanguageError("aggregates don't nest")
    x = integer(compile_node(n.args[0], replace(s, inside=True)))
    if n.value == "SUM" and not scalars.is_numeric(x.type):
        raise LanguageError(f"SUM does not take {x.type}")
    made = {"SUM": F.sum, "MIN": F.min, "MAX": F.max}[str(n.value)](x.column)
    if isinstance(s.window, WindowSpec):
        made = made.over(s.window)
    elif s.window is not None:
        made = s.window(str(n.value), x.column)
    return Typed(made.cast(x.type.spark) if n.value == "SUM" else made, x.type.null(), True, True)


def scope_of(sides: dict[str, tuple[list[Field], dict[str, Column]]], **more) -> Scope:
    return Scope({alias: {f.name: Typed(columns[f.name], f.type) for f in fields} for alias, (fields, columns) in sides.items()}, **more)


def output_column(name: str, x: Typed) -> tuple[Field, Column]:
    if x.type.name == "NIL":
        raise LanguageError(f"{name}: NULL as a field needs a CAST")
    if x.type.name == "BOOLEAN":
        x = integer(x)
    kind = Type("INTEGER", x.type.nullable) if x.type.name == "INTERVAL" else x.type
    return Field(name, kind), x.column.alias(name)


def record(text: str, s: Scope) -> list[tuple[Field, Column]]:
    """The fields and columns that a record constructor makes."""
    out: list[tuple[Field, Column]] = []
    s = replace(s, locals=dict(s.locals))
    for item in Parser(text).record():
        if item.kind == "all":
            if item.value not in s.fields:
                raise LanguageError(f"unknown alias {item.value}")
            for name in s.fields[str(item.value)]:
                out.append(output_column(name, s.find(str(item.value), name)))
        elif item.kind == "columns":
            pattern, shape = item.value  # type: ignore[misc]
            for alias in sorted(s.fields):
                for name in s.fields[alias]:
                    if m := re.fullmatch(pattern, name):
                        new = re.sub(r"\$(\d)|\\(\d)", lambda g, m=m: m[int(g[1] or g[2])] or "", shape) if shape else name
                        out.append(output_column(new, s.find(alias, name)))
        elif item.kind == "declare":
            s.locals[str(item.value)] = compile_node(item.args[0], s)
        else:
            value, name = item.args[0], item.value
            if name is None:
                if value.kind != "column":
                    raise LanguageError("an expression needs a name")
                name = value.value[1]
            elif str(name) in scalars.RESERVED:
                raise LanguageError(f"{name} is the name of a function")
            out.append(output_column(str(name), compile_node(value, s)))
    names = [f.name for f, _ in out]
    if twice := {x for x in names if names.count(x) > 1}:
        raise LanguageError(f"fields {sorted(twice)} are made twice")
    return out


def value(text: str, s: Scope) -> Typed:
    """A single expression, after any DECLAREs."""
    declares, body = Parser(text).single()
    s = replace(s, locals=dict(s.locals))
    for name, node in declares:
        s.locals[name] = compile_node(node, s)
    return compile_node(body, s)


def condition(text: str, s: Scope) -> Column:
    """A predicate: NULL is false. Its outermost ANDs whose right sides cannot fail are plain, so that they can be pushed down."""
    declares, body = Parser(text).single()
    s = replace(s, locals=dict(s.locals))
    for name, node in declares:
        s.locals[name] = compile_node(node, s)

    def plain(n: Node) -> Typed:
        if n.kind in ("and", "or"):
            a, b = (boolean(plain(x)) for x in n.args)
            if not b.raises:
                return Typed(a.column & b.column if n.kind == "and" else a.column | b.column, Type("BOOLEAN", a.type.nullable or b.type.nullable), **_mixed(a, b))
        return compile_node(n, s)

    return boolean(plain(body)).column
