"""The statement language of folds, as Python closures over plain values.

Statements run row after row where the data are, with the same results as the columns that the
expression compiler makes: its types decide conversions, whole numbers divide toward zero and
don't overflow in silence, decimals are rounded as decimal(28, 9), NULL makes NULL, AND and OR
take a NULL on the left as false.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import struct
from collections.abc import Callable
from decimal import ROUND_HALF_EVEN, ROUND_HALF_UP, Context, Decimal
from zoneinfo import ZoneInfo

import regex

from rivulet.functions import expressions as X
from rivulet.functions.scalars import EASTERN, FUNCTIONS, LOWER, SPACE, UPPER
from rivulet.functions.types import SCALE, Field, Type, Typed, common, declared, literal_null, widens
from rivulet.plans.syntax import LanguageError, Node, Parser

Value = Callable[[dict], object]
Kind = Callable[[Node], Type]
WIDE = Context(prec=60)
EPOCH = dt.date(1970, 1, 1)
_lower, _upper = str.maketrans(UPPER, LOWER), str.maketrans(LOWER, UPPER)


def _strict(f: Callable) -> Callable:
    return lambda *v: None if any(x is None for x in v) else f(*v)


def scaled(x: Decimal, digits: int = SCALE) -> Decimal:
    return x.quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP, WIDE)


def _divide(a, b):
    if isinstance(a, int):
        q = abs(a) // abs(b)
        return q if (a < 0) == (b < 0) else -q
    # Spark keeps 10 digits of a quotient of decimal(28, 9), and 6 of a product
    return scaled(scaled(WIDE.divide(a, b), 10)) if isinstance(a, Decimal) else a / b


def _times(a, b):
    return scaled(scaled(WIDE.multiply(a, b), 6)) if isinstance(a, Decimal) else a * b


def _modulo(a, b):
    if isinstance(a, int):
        return a - b * _divide(a, b)
    return WIDE.remainder(a, b) if isinstance(a, Decimal) else math.fmod(a, b)


BINARY = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": _times, "/": _divide, "%": _modulo, "&": lambda a, b: a & b, "|": lambda a, b: a | b, "^": lambda a, b: a ^ b,
    "=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b,
}
RANGE = {"INTEGER": 1 << 31, "BIGINT": 1 << 63}


def in_range(v, kind: str):
    """v, where a number of that type can hold it."""
    if v is not None and kind in RANGE and not -RANGE[kind] <= v < RANGE[kind]:
        raise OverflowError(f"{v} is beyond {kind}")
    return v


def substring(s: str, start: int, n: int) -> str:
    """n bytes (all, if n < 0) from byte `start`, 0 the first; below 0 from the end, as Spark's substring counts."""
    raw = s.encode()
    n = len(raw) if n < 0 else n
    at = start if start >= 0 else 0 if start == -1 else len(raw) + start + 1
    return raw[max(at, 0) : max(at + n, 0)].decode(errors="replace")


def month_end(d: dt.date) -> dt.date:
    first = dt.date(d.year + d.month // 12, d.month % 12 + 1, 1)
    return first - dt.timedelta(1)


def add_interval(v, unit: str, count: int):
    """A date or datetime and so many units, as the column of that name adds them."""
    if unit in ("MONTH", "YEAR"):
        day = v.date() if isinstance(v, dt.datetime) else v
        months = day.year * 12 + day.month - 1 + count * (12 if unit == "YEAR" else 1)
        end = month_end(dt.date(months // 12, months % 12 + 1, 1))
        moved = end if day == month_end(day) else end.replace(day=min(day.day, end.day))
        return dt.datetime.combine(moved, v.time()) if isinstance(v, dt.datetime) else moved
    if unit == "DAY" and not isinstance(v, dt.datetime):
        return v + dt.timedelta(count)
    whole = v if isinstance(v, dt.datetime) else dt.datetime(v.year, v.month, v.day)
    return whole + dt.timedelta(**{unit.lower() + "s": count})


def _epoch(t: dt.datetime) -> int:
    return math.floor(t.replace(tzinfo=ZoneInfo(EASTERN)).timestamp())


def _exp(x: float) -> float:
    try:
        return math.exp(x)
    except OverflowError:
        return math.inf


#: As FUNCTIONS, whose argument types hold here too.
CALLS: dict[str, Callable] = {
    "ceil": lambda x: float(math.ceil(x)), "floor": lambda x: float(math.floor(x)), "sqrt": lambda x: math.sqrt(x) if x >= 0 else math.nan, "exp": _exp,
    "log": lambda x: math.log(x) if x > 0 else -math.inf if x == 0 else math.nan,
    "length": lambda s: len(s.encode()), "trim": lambda s: s.strip(SPACE), "ltrim": lambda s: s.lstrip(SPACE), "rtrim": lambda s: s.rstrip(SPACE),
    "lower": lambda s: s.translate(_lower), "upper": lambda s: s.translate(_upper), "md5": lambda s: hashlib.md5(s.encode()).hexdigest(), "substr": substring,
    "unix_timestamp": _epoch, "from_unixtime": lambda x: dt.datetime.fromtimestamp(x, ZoneInfo(EASTERN)).replace(tzinfo=None),
    "date": lambda t: t.date(), "dayofweek": lambda d: d.isoweekday() % 7 + 1, "dayofmonth": lambda d: d.day, "dayofyear": lambda d: d.timetuple().tm_yday,
    "month": lambda d: d.month, "year": lambda d: d.year, "last_day": month_end, "datediff": lambda a, b: (a - b).days, "julian_day": lambda d: (d - EPOCH).days + 2440588,
}


def as_text(v) -> str:
    if isinstance(v, float):
        return f"{v:.15g}"
    if isinstance(v, Decimal):
        text = format(v, "f")
        return text.rstrip("0").rstrip(".") if "." in text else text
    if isinstance(v, dt.datetime):
        return v.strftime("%Y-%m-%d %H:%M:%S")
    return str(int(v)) if isinstance(v, bool) else str(v)


def cast(v, kind: str, size: int | None = None):
    """A value that is not NULL, in another type."""
    if kind in RANGE:
        if isinstance(v, str):
            m = regex.match(r"\s*([+-]?\d+)", v)
            n = int(m[1]) if m else 0
            return n if -RANGE[kind] <= n < RANGE[kind] else 0
        if isinstance(v, dt.datetime):
            return int(v.strftime("%Y%m%d%H%M%S" if kind == "BIGINT" else "%Y%m%d"))
        if isinstance(v, dt.date):
            return int(v.strftime("%Y%m%d"))
        if isinstance(v, int):  # of a BIGINT, the low 32 bits
            return (v + RANGE[kind]) % (2 * RANGE[kind]) - RANGE[kind]
        return in_range(int(v.to_integral_value(ROUND_HALF_EVEN)) if isinstance(v, Decimal) else int(v), kind)
    if kind in ("DOUBLE", "DECIMAL"):
        if isinstance(v, str):
            m = regex.match(r"\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", v)
            v = Decimal(m[1] if m else 0)
        elif isinstance(v, dt.date):
            v = cast(v, "BIGINT")
        return float(v) if kind == "DOUBLE" else scaled(Decimal(repr(v)) if isinstance(v, float) else Decimal(v))
    if kind in ("VARCHAR", "CHAR"):
        text = v if isinstance(v, str) else as_text(v)
        return text[:size].ljust(size) if kind == "CHAR" else text  # type: ignore[arg-type]
    if kind == "DATE":
        return dt.date.fromisoformat(v.strip()[:10]) if isinstance(v, str) else v
    if kind == "DATETIME":
        return dt.datetime.fromisoformat(v.strip()) if isinstance(v, str) else v if isinstance(v, dt.datetime) else dt.datetime(v.year, v.month, v.day)
    return bool(v)


def _signed(x: int, bits: int = 32) -> int:
    return (x + (1 << bits - 1)) % (1 << bits) - (1 << bits - 1)


def murmur(v, kind: str, seed: int) -> int:
    """One step of the 32-bit hash that `#` takes over its values; NULL leaves the seed."""
    mask = 0xFFFFFFFF

    def turn(x: int, r: int) -> int:
        return (x << r | x >> 32 - r) & mask

    def take(h: int, word: int) -> int:
        k = turn((word & mask) * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask
        return (turn(h ^ k, 13) * 5 + 0xE6546B64) & mask

    def end(h: int, n: int) -> int:
        h ^= n
        h = (h ^ h >> 16) * 0x85EBCA6B & mask
        h = (h ^ h >> 13) * 0xC2B2AE35 & mask
        return _signed(h ^ h >> 16)

    if v is None:
        return seed
    h = seed & mask
    if kind == "DOUBLE":
        v = struct.unpack("<q", struct.pack("<d", 0.0 if v == 0 else v))[0]
    elif kind == "DATETIME":
        t = v - dt.datetime(1970, 1, 1)
        v = (t.days * 86400 + t.seconds) * 1_000_000 + t.microseconds
    elif kind == "DATE":
        v = (v - EPOCH).days
    if kind in ("INTEGER", "BOOLEAN", "DATE"):
        return end(take(h, int(v)), 4)
    if kind in ("BIGINT", "DOUBLE", "DATETIME"):
        return end(take(take(h, v), v >> 32), 8)
    if kind == "DECIMAL":
        n = int(scaled(v).scaleb(SCALE, WIDE))
        raw = n.to_bytes((n + (n < 0)).bit_length() // 8 + 1, "big", signed=True)
    else:
        raw = v.encode()
    whole = len(raw) // 4 * 4
    for (word,) in struct.iter_unpack("<I", raw[:whole]):
        h = take(h, word)
    for byte in raw[whole:]:
        h = take(h, _signed(byte, 8))
    return end(h, len(raw))


def evaluator(n: Node, kind: Kind) -> Value:
    """A closure over a dictionary of values. kind: the type that the expression compiler gives a node."""
    return made(n, kind) if n.kind != "interval" else made(n.args[0], kind)


def convert(n: Node, kind: Kind, to: Type) -> Value:
    """The node's value in a type that its own widens to."""
    value, own = evaluator(n, kind), kind(n)
    if own.name == to.name or to.name in ("VARCHAR", "NIL", "ARRAY") or own.name == "NIL":
        return value
    f = _strict(lambda v: cast(v, to.name))
    return lambda e: f(value(e))


def made(n: Node, kind: Kind) -> Value:
    if n.kind in ("literal", "boolean"):
        value = scaled(Decimal(n.value)) if n.kind == "literal" and n.args[0] == "decimal" else n.value  # type: ignore[arg-type]
        return lambda e: value
    if n.kind == "null":
        return lambda e: None
    if n.kind == "column":
        name = n.value[1]  # type: ignore[index]
        return lambda e: e[name]
    own = kind(n)
    if n.kind == "case":
        arms, other = [(evaluator(c, kind), convert(v, kind, own)) for c, v in n.args[0]], convert(n.args[1], kind, own)

        def chosen(e):
            for c, v in arms:
                if c(e):
                    return v(e)
            return other(e)

        return chosen
    if n.kind == "choice":
        c, (x, y) = evaluator(n.args[0], kind), (convert(a, kind, own) for a in n.args[1:])
        return lambda e: x(e) if c(e) else y(e)
    if n.kind == "array":
        members = [convert(a, kind, own.element) for a in n.args]  # type: ignore[arg-type]
        return lambda e: [m(e) for m in members]
    parts = [evaluator(a, kind) for a in n.args]
    if n.kind == "and":
        a, b = parts
        return lambda e: b(e) if a(e) else False
    if n.kind == "or":
        a, b = parts
        return lambda e: True if a(e) else b(e)
    if n.kind == "isnull":
        (a,) = parts
        return (lambda e: a(e) is None) if n.value else (lambda e: a(e) is not None)
    if n.kind == "cast":
        to, size = n.value  # type: ignore[misc]
        f = _strict(lambda v: cast(v, to, size))
        return lambda e: f(parts[0](e))
    if n.kind == "binary":
        return binary(n, kind, own)
    if n.kind == "hash":
        names = [kind(a).name for a in n.args]

        def hashed(e):
            out = 42
            for p, name in zip(parts, names, strict=True):
                out = murmur(p(e), name, out)
            return out

        return hashed
    if n.kind == "prefix":
        wide = kind(n.args[0]).name == "BIGINT"
        f = _strict(lambda v: (v + (1 << 63)) >> 33 if wide else (v + (1 << 31)) >> 1)
        return lambda e: f(parts[0](e))
    if n.kind == "not":
        f = _strict(lambda x: not x)
    elif n.kind == "index":
        f = _strict(element)
    elif n.kind == "unary":
        sign = str(n.value)
        f = _strict(lambda x: in_range(-x, own.name) if sign == "-" else ~x if sign == "~" else x)
    elif n.kind == "call":
        return call(n, kind, own)
    else:
        raise LanguageError(f"{n.value or n.kind} is not supported in update")
    return lambda e: f(*[p(e) for p in parts])


def element(array: list, i: int):
    if not 0 <= i < len(array):
        raise IndexError(f"index {i} is out of bounds")
    return array[i]


def binary(n: Node, kind: Kind, own: Type) -> Value:
    op, (x, y) = str(n.value), n.args
    s, t = kind(x), kind(y)
    if "INTERVAL" in (s.name, t.name):
        if s.name == "INTERVAL":
            x, y, s, t = y, x, t, s
        unit, sign = str(t.size), -1 if op == "-" else 1
        a, b = evaluator(x, kind), evaluator(y, kind)
        f = _strict(lambda v, count: add_interval(v, unit, sign * count))
    elif op == "RLIKE":
        a, b = evaluator(x, kind), evaluator(y, kind)
        known = regex.compile(str(y.value)) if y.kind == "literal" else None
        f = _strict(lambda v, p: (known or regex.compile(p)).fullmatch(v) is not None)
    else:
        if op not in BINARY:
            raise LanguageError(f"{op} is not implemented")
        to = common(s, t) if op in ("=", "<>", "<", ">", "<=", ">=") else own
        if to.name in ("CHAR", "VARCHAR"):
            to = Type("VARCHAR")
        a, b, g = convert(x, kind, to), convert(y, kind, to), BINARY[op]
        f = _strict(lambda v, w: in_range(g(v, w), own.name))
    return lambda e: f(a(e), b(e))


def call(n: Node, kind: Kind, own: Type) -> Value:
    name = str(n.value)
    low = name.lower()
    if low in ("isnull", "ifnull"):
        a, b = (convert(x, kind, own) for x in n.args)
        return lambda e: b(e) if (v := a(e)) is None else v
    if low in ("least", "greatest"):
        parts = [convert(x, kind, own) for x in n.args]

        def extreme(e):
            values = [p(e) for p in parts]
            out = values[0]
            for v in values[1:]:
                keep = out is not None and v is not None and (out < v if low == "least" else out > v)
                out = out if keep else v
            return out

        return extreme
    if name == "round":
        value, digits = convert(n.args[0], kind, Type("DECIMAL")), n.args[1].value
        f = _strict(lambda x: scaled(x.quantize(Decimal(1).scaleb(-digits), ROUND_HALF_EVEN, WIDE)))  # type: ignore[operator]
        return lambda e: f(value(e))
    if name == "utc_timestamp":
        now = dt.datetime.now(dt.UTC).replace(tzinfo=None)  # the query's, as in columns
        return lambda e: now
    args = [convert(a, kind, Type(w)) for a, w in zip(n.args, FUNCTIONS[name][0], strict=True)]
    f = _strict(CALLS[name])
    return lambda e: f(*[a(e) for a in args])


class Return(Exception):
    """Ends the update of a row."""


class Fold:
    """Type-checked initialize and update. reads: the input fields that update uses."""

    def __init__(self, initialize: str, update: str, inputs: list[Field], state: list[Field]):
        self.state = [f.name for f in state]
        self.reads: set[str] = set()
        kinds = {f.name: f.type for f in [*inputs, *state]}
        self.first = []
        known: dict[str, Type] = {}
        for i in Parser(initialize).record():
            name = str(i.value or i.args[0].value[1])
            self.first.append((name, evaluator(i.args[0], lambda n: self._kind(n, known))))
            if i.kind == "declare":
                known[name] = self._kind(i.args[0], known)
        p = Parser(update)
        self.run = self._statement(p.statements(), kinds, frozenset(f.name for f in inputs))
        self.casts = [(f.name, f.type.name) for f in state]

    @staticmethod
    def _kind(n: Node, kinds: dict[str, Type]) -> Type:
        """The expression's type, by the compiler that makes columns."""
        return X.compile_node(n, X.Scope({}, {k: Typed(literal_null(t), t) for k, t in kinds.items()})).type

    def _value(self, n: Node, kinds: dict[str, Type], to: Type | None = None) -> Value:
        now = dict(kinds)
        seen: dict[int, Type] = {}

        def kind(x: Node) -> Type:
            if id(x) not in seen:
                seen[id(x)] = self._kind(x, now)
            return seen[id(x)]

        return evaluator(n, kind) if to is None else convert(n, kind, to)

    def _typed(self, n: Node, kinds: dict[str, Type], inputs: frozenset[str]) -> Type:
        self._read(n, inputs)
        own = self._kind(n, kinds)
        return Type("INTEGER", own.nullable) if own.name == "BOOLEAN" else own

    def _read(self, n, inputs: frozenset[str]) -> None:
        if isinstance(n, Node):
            if n.kind == "column" and n.value[1] in inputs:  # type: ignore[index]
                self.reads.add(n.value[1])  # type: ignore[index]
            for a in n.args:
                self._read(a, inputs)
        elif isinstance(n, tuple):
            for a in n:
                self._read(a, inputs)

    def _condition(self, n: Node, kinds: dict[str, Type], inputs: frozenset[str]) -> Value:
        kind = self._typed(n, kinds, inputs)
        if kind.name not in ("INTEGER", "BOOLEAN"):
            raise LanguageError(f"{kind} is no condition")
        return self._value(n, kinds)

    def _statement(self, n: Node, kinds: dict[str, Type], inputs: frozenset[str]) -> Callable[[dict], None]:
        if n.kind == "block":
            parts = [self._statement(x, kinds, inputs) for x in n.args]

            def block(e: dict) -> None:
                for p in parts:
                    p(e)

            return block
        if n.kind == "variable":
            kinds[str(n.value)] = declared(n.args[0])
            name = str(n.value)
            return lambda e: e.__setitem__(name, None)
        if n.kind == "bind":
            name, value, own = str(n.value), self._value(n.args[0], kinds), self._typed(n.args[0], kinds, inputs)
            kinds[name] = own
            return lambda e: e.__setitem__(name, value(e))
        if n.kind == "set":
            name, (index, body) = str(n.value), n.args
            if name not in kinds or name in inputs and name not in self.state:
                raise LanguageError(f"{name} can't be set")
            kind = kinds[name]
            target = kind.element if index is not None else kind
            if target is None or not widens(self._typed(body, kinds, inputs), target):
                raise LanguageError(f"{name} can't be set to that type")
            to = target.name
            same = to in ("ARRAY", "VARCHAR", "NIL")
            put = _strict((lambda v: v) if same else (lambda v: cast(v, to, target.size)))
            value = self._value(body, kinds)
            if index is None:
                return lambda e: e.__setitem__(name, put(value(e)))
            self._typed(index, kinds, inputs)
            at = self._value(index, kinds)

            def put_at(e: dict) -> None:
                i, array = at(e), e[name]
                if not 0 <= i < len(array):  # type: ignore[operator]
                    raise IndexError(f"index {i} of {name} is out of bounds")
                array[i] = put(value(e))

            return put_at
        if n.kind == "if":
            c = self._condition(n.args[0], kinds, inputs)
            yes, no = (self._statement(x, kinds, inputs) for x in n.args[1:])
            return lambda e: yes(e) if c(e) else no(e)
        if n.kind == "while":
            c, body = self._condition(n.args[0], kinds, inputs), self._statement(n.args[1], kinds, inputs)

            def loop(e: dict) -> None:
                while c(e):
                    body(e)

            return loop
        if n.kind == "switch":
            self._typed(n.args[0], kinds, inputs)
            on, arms = self._value(n.args[0], kinds), {k: self._statement(b, kinds, inputs) for k, b in n.args[1]}
            return lambda e: arms.get(on(e), lambda _: None)(e)  # type: ignore[arg-type]
        if n.kind == "return":

            def leave(e: dict) -> None:
                raise Return

            return leave
        raise LanguageError(f"{n.kind} is not supported in update")

    def start(self) -> dict:
        e: dict = {}
        for name, value in self.first:
            v = value(e)
            e[name] = list(v) if isinstance(v, list) else v
        return e

    def step(self, state: dict, row: dict) -> None:
        e = {**row, **state}
        try:
            self.run(e)
        except Return:
            pass
        for k in self.state:
            state[k] = e[k]

    def result(self, state: dict) -> tuple:
        return tuple(list(v) if isinstance(v := state[k], list) else v if v is None or t not in ("INTEGER", "BIGINT", "DOUBLE", "DECIMAL") else cast(v, t) for k, t in self.casts)
