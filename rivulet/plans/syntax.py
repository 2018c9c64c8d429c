"""Tokens and recursive-descent parsers: expressions, record constructors, formats, statements and graphs."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from decimal import Decimal


class LanguageError(ValueError):
    """A script that the language does not accept."""


@dataclass(frozen=True)
class Node:
    """kind, a value (name, operator, literal), and operands."""

    kind: str
    value: object = None
    args: tuple = ()


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    value: object = None


#: Fixed values.
KEYWORDS = frozenset(
    "AND AS BEGIN BIGINT BOOLEAN BREAK CASE CAST CHAR CONTINUE DATETIME DECIMAL DECLARE DOUBLE ELSE END FALSE IF INTEGER INTERVAL IS LIKE "
    "MAX MIN NOT NULL NVARCHAR OR PRECISION PRINT RAISERROR RETURN RLIKE SET SUM SWITCH THEN TRUE VARCHAR WHEN WHILE".split()
)
ESCAPES = {"b": "\b", "t": "\t", "n": "\n", "f": "\f", "r": "\r", '"': '"', "'": "'", "\\": "\\"}

_LEX = re.compile(
    r"""(?P<space>\s+|/\*.*?\*/|//[^\n]*)
    |(?P<double>(?:\d+\.\d*|\.\d+)[eE][+-]?\d+[fFdD]?|\d+(?:[eE][+-]?\d+[fFdD]?|[fFdD]\b))
    |(?P<decimal>\d+\.\d*|\.\d+)
    |(?P<hex>0[xX][0-9a-fA-F]+(?:LL)?)
    |(?P<bigint>\d+LL)
    |(?P<int>\d+)
    |(?P<wide>N'(?:\\.|[^\\'])*')
    |(?P<id>[A-Za-z_][A-Za-z0-9_]*)
    |(?P<string>'(?:\\.|[^\\'])*')
    |(?P<quoted>"(?:\\.|[^\\"])*")
    |(?P<pattern>`[^`]*`)
    |(?P<op>->|<>|>=|<=|[-+*/%^|&~=<>?:;,.()\[\]\#$])""",
    re.S | re.X,
)


def unescape(body: str) -> str:
    def one(m: re.Match) -> str:
        s = m[1]
        if s[0] == "u" and len(s) == 5:
            return chr(int(s[1:], 16))
        if s[0] in "01234567":
            return chr(int(s, 8))
        return ESCAPES.get(s.lower() if s.lower() in "btnfr" else s, s)

    return re.sub(r"\\(u[0-9a-fA-F]{4}|[0-3][0-7]{2}|[0-7]{1,2}|.)", one, body, flags=re.S)


def tokens(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _LEX.match(text, at)
        if not m:
            raise LanguageError(f"unexpected {text[at : at + 10]!r}")
        at, kind, s = m.end(), m.lastgroup, m[0]
        if kind == "space":
            continue
        if kind in ("hex", "wide"):
            raise LanguageError(f"literal {s} is not supported")
        if kind == "id" and s.upper() in KEYWORDS:
            out.append(Token("keyword", s.upper(), s))
        elif kind in ("string", "quoted"):
            out.append(Token(kind, s, unescape(s[1:-1]) if kind == "string" else s[1:-1].replace('\\"', '"')))
        elif kind == "int":
            out.append(Token(kind, s, int(s)))
        elif kind == "bigint":
            out.append(Token(kind, s, int(s[:-2])))
        elif kind == "decimal":
            out.append(Token(kind, s, Decimal(s)))
        elif kind == "double":
            out.append(Token(kind, s, float(s.rstrip("fFdD"))))
        elif kind == "pattern":
            out.append(Token(kind, s, s[1:-1]))
        else:
            out.append(Token(kind, s, s))
    return [*out, Token("end", "")]


#: Binary operators from loose to tight; bitwise ones bind looser than comparisons and share a level.
LEVELS = (("^", "|", "&"), ("=", ">", "<", ">=", "<=", "<>", "LIKE", "RLIKE"), ("+", "-"), ("*", "/", "%"))


class Parser:
    def __init__(self, text: str):
        self.items, self.at = tokens(text), 0

    @property
    def now(self) -> Token:
        return self.items[self.at]

    def ahead(self, n: int = 1) -> Token:
        return self.items[min(self.at + n, len(self.items) - 1)]

    def take(self) -> Token:
        t = self.now
        self.at += 1
        return t

    def sees(self, *texts: str) -> bool:
        return self.now.kind in ("op", "keyword") and self.now.text in texts

    def skip(self, text: str) -> bool:
        if self.sees(text):
            self.at += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.skip(text):
            raise LanguageError(f"expected {text!r}, found {self.now.text!r}")

    def name(self) -> str:
        if self.now.kind != "id":
            raise LanguageError(f"expected a name, found {self.now.text!r}")
        return str(self.take().value)

    def word(self) -> str:
        """A name that may be a keyword: operators and parameters."""
        if self.now.kind not in ("id", "keyword"):
            raise LanguageError(f"expected a name, found {self.now.text!r}")
        return str(self.take().value)

    def finished(self) -> None:
        if self.now.kind != "end":
            raise LanguageError(f"unexpected {self.now.text!r}")

    # expressions

    def expression(self) -> Node:
        cond = self.disjunction()
        if self.skip("?"):
            yes = self.expression()
            self.need(":")
            return Node("choice", None, (cond, yes, self.expression()))
        return cond

    def disjunction(self) -> Node:
        out = self.conjunction()
        while self.skip("OR"):
            out = Node("or", None, (out, self.conjunction()))
        return out

    def conjunction(self) -> Node:
        out = self.negation()
        while self.skip("AND"):
            out = Node("and", None, (out, self.negation()))
        return out

    def negation(self) -> Node:
        if self.skip("NOT"):
            return Node("not", None, (self.negation(),))
        out = self.binary(0)
        if self.skip("IS"):
            negated = self.skip("NOT")
            self.need("NULL")
            return Node("isnull", not negated, (out,))
        return out

    def binary(self, level: int) -> Node:
        if level == len(LEVELS):
            return self.unary()
        out = self.binary(level + 1)
        while self.sees(*LEVELS[level]):
            op = self.take().text
            out = Node("binary", op, (out, self.binary(level + 1)))
            if level == 1:  # comparisons don't chain
                break
        return out

    def unary(self) -> Node:
        if self.sees("+", "-"):
            return Node("unary", self.take().text, (self.unary(),))
        if self.skip("~"):
            return Node("unary", "~", (self.postfix(),))
        return self.postfix()

    def listed(self, close: str) -> tuple[Node, ...]:
        out: list[Node] = []
        while not self.skip(close):
            if out:
                self.need(",")
            out.append(self.expression())
        return tuple(out)

    def postfix(self) -> Node:
        t = self.take()
        if t.kind in ("int", "bigint", "decimal", "double", "string"):
            return Node("literal", t.value, (t.kind,))
        if t.kind == "keyword":
            return self.keyword(t)
        if t.kind == "id":
            name = str(t.value)
            if self.skip("("):
                return Node("call", name, self.listed(")"))
            if self.sees(".") and self.ahead().kind == "id":
                self.take()
                return Node("column", (name, self.name()))
            if self.skip("["):
                index = self.expression()
                self.need("]")
                return Node("index", None, (Node("column", (None, name)), index))
            return Node("column", (None, name))
        if t.text == "(":
            out = self.expression()
            self.need(")")
            return out
        if t.text == "[":
            return Node("array", None, self.listed("]"))
        if t.text in ("#", "$"):
            self.need("(")
            return Node("hash" if t.text == "#" else "prefix", None, self.listed(")"))
        raise LanguageError(f"unexpected {t.text!r}")

    def keyword(self, t: Token) -> Node:
        if t.text in ("TRUE", "FALSE"):
            return Node("boolean", t.text == "TRUE")
        if t.text == "NULL":
            return Node("null")
        if t.text in ("SUM", "MIN", "MAX"):
            self.need("(")
            out = self.expression()
            self.need(")")
            return Node("aggregate", t.text, (out,))
        if t.text == "CAST":
            self.need("(")
            value = self.expression()
            self.need("AS")
            kind = self.type()
            self.need(")")
            return Node("cast", kind, (value,))
        if t.text == "INTERVAL":
            value = self.binary(1)
            return Node("interval", self.name().upper(), (value,))
        if t.text == "CASE":
            if not self.sees("WHEN"):
                raise LanguageError("CASE needs WHEN: the form with an operand is not supported")
            arms = []
            while self.skip("WHEN"):
                when = self.disjunction()
                self.need("THEN")
                arms.append((when, self.disjunction()))
            other = self.disjunction() if self.skip("ELSE") else Node("null")
            self.need("END")
            return Node("case", None, (tuple(arms), other))
        raise LanguageError(f"unexpected {t.text}")

    def type(self) -> tuple[str, int | None]:
        t = self.take()
        if t.kind == "id" and str(t.value).upper() == "DATE":
            return ("DATE", None)
        if t.kind != "keyword" or t.text not in ("INTEGER", "DOUBLE", "CHAR", "VARCHAR", "NVARCHAR", "DECIMAL", "BOOLEAN", "DATETIME", "BIGINT"):
            raise LanguageError(f"unknown type {t.text!r}")
        if t.text == "NVARCHAR":
            raise LanguageError("NVARCHAR is not supported")
        if t.text == "DOUBLE":
            self.need("PRECISION")
        size = None
        if t.text in ("CHAR", "VARCHAR") and self.skip("("):
            size = int(self.take().value)  # type: ignore[call-overload]
            self.need(")")
        if t.text == "CHAR" and size is None:
            raise LanguageError("CHAR needs a length")
        return (t.text, size if t.text == "CHAR" else None)

    def declaration(self) -> tuple[str, Node]:
        name = self.name()
        self.need("=")
        return name, self.expression()

    # records, formats

    def record(self) -> list[Node]:
        """Nodes `all` (alias), `columns` (pattern, format), `declare` (name) and `field` (name or None)."""
        out: list[Node] = []
        while not out or self.skip(","):
            if self.now.kind == "id" and self.ahead().text == "." and self.ahead(2).text == "*":
                out.append(Node("all", self.name()))
                self.at += 2
            elif self.now.kind == "pattern":
                pattern, shape = self.take().value, None
                if self.skip("AS"):
                    if self.now.kind != "pattern":
                        raise LanguageError("a pattern's new name is written in back quotes")
                    shape = self.take().value
                out.append(Node("columns", (pattern, shape)))
            elif self.skip("DECLARE"):
                name, value = self.declaration()
                out.append(Node("declare", name, (value,)))
            else:
                value = self.expression()
                out.append(Node("field", self.name() if self.skip("AS") else None, (value,)))
        self.finished()
        return out

    def single(self) -> tuple[list[tuple[str, Node]], Node]:
        """An expression after any `DECLARE x = ...,`."""
        local = []
        while self.skip("DECLARE"):
            local.append(self.declaration())
            self.need(",")
        out = self.expression()
        self.finished()
        return local, out

    def format(self) -> list[tuple[str, tuple[str, int | None], bool]]:
        """(name, type, nullable) of each field; the default is not nullable."""
        out: list[tuple[str, tuple[str, int | None], bool]] = []
        while not out or self.skip(","):
            t = self.take()
            if t.kind not in ("id", "keyword"):
                raise LanguageError(f"expected a field name, found {t.text!r}")
            kind = self.type()
            nullable = self.skip("NULL")
            if not nullable and self.skip("NOT"):
                self.need("NULL")
            out.append((str(t.value), kind, nullable))
        self.finished()
        return out

    # statements

    def statements(self, *ends: str) -> Node:
        out = []
        while not (self.sees(*ends) if ends else self.now.kind == "end"):
            if self.now.kind == "end":
                raise LanguageError(f"expected {ends}")
            out.append(self.statement())
            self.skip(";")
        return Node("block", None, tuple(out))

    def statement(self) -> Node:
        if self.skip("SET"):
            name = self.name()
            index = None
            if self.skip("["):
                index = self.expression()
                self.need("]")
            self.need("=")
            return Node("set", name, (index, self.expression()))
        if self.skip("DECLARE"):
            name = self.name()
            if self.skip("="):
                return Node("bind", name, (self.expression(),))
            return Node("variable", name, (self.type(),))
        if self.skip("IF"):
            cond, yes = self.expression(), self.statement()
            self.skip(";")
            return Node("if", None, (cond, yes, self.statement() if self.skip("ELSE") else Node("block")))
        if self.skip("BEGIN"):
            out = self.statements("END")
            self.need("END")
            return out
        if self.skip("WHILE"):
            cond = self.expression()
            if self.now.kind == "id" and str(self.now.value).upper() == "DO":
                self.take()
            out = self.statements("END")
            self.need("END")
            self.need("WHILE")
            return Node("while", None, (cond, out))
        if self.skip("SWITCH"):
            on = self.expression()
            self.need("BEGIN")
            arms = []
            while self.skip("CASE"):
                label = int(self.take().value)  # type: ignore[call-overload]
                body = []
                while not self.sees("CASE", "END"):
                    body.append(self.statement())
                    self.skip(";")
                arms.append((label, Node("block", None, tuple(body))))
            self.need("END")
            return Node("switch", None, (on, tuple(arms)))
        if self.skip("RETURN"):
            return Node("return")
        raise LanguageError(f"statement {self.now.text!r} is not supported")


@dataclass
class Operator:
    """A node of a graph: repeated parameters are kept in order."""

    name: str
    kind: str
    params: list[tuple[str, str | int]] = field(default_factory=list)

    def all(self, *names: str) -> list:
        return [v for k, v in self.params if k.lower() in {n.lower() for n in names}]

    def get(self, *names: str, default=None):
        return next(iter(self.all(*names)), default)

    def flag(self, name: str) -> bool:
        value = str(self.get(name, default="false")).lower()
        if value not in ("true", "false"):
            raise LanguageError(f"{self.name}: {name} must be true or false")
        return value == "true"


def parse_graph(text: str) -> tuple[dict[str, Operator], list[tuple[str, str]]]:
    p = Parser(text)
    nodes: dict[str, Operator] = {}
    edges: list[tuple[str, str]] = []
    while p.now.kind != "end":
        first = p.word()
        if p.skip("->"):
            edges.append((first, p.word()))
        else:
            name, kind = first, first
            if p.skip("="):
                kind = p.word()
            p.need("[")
            node = Operator(name, kind)
            while not p.skip("]"):
                if node.params:
                    p.need(",")
                key = p.word()
                p.need("=")
                value = p.take()
                if value.kind not in ("int", "quoted"):
                    raise LanguageError(f"{name}: {key} must be a number or a string in double quotes")
                node.params.append((key, value.value))  # type: ignore[arg-type]
            if name in nodes:
                raise LanguageError(f"operator {name} is defined twice")
            nodes[name] = node
        p.need(";")
    for a, b in edges:
        for x in (a, b):
            if x not in nodes:
                raise LanguageError(f"arrow to or from unknown operator {x}")
    return nodes, edges
