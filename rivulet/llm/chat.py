"""Chat formatting by schema fingerprints.

A table's layout is its set of nested field paths. The paths that any mapping names are kept,
sorted and hashed; the hash selects a declarative mapping, which says where the turns are and
what their roles and texts are called. So layouts of prompt and response columns, of
instructions, of lists of messages and of one row a turn all become canonical turns (conv_id,
turn, role, text), whatever other columns there are.

The template writes a turn as `<s>[ROLE]role[/ROLE]text</s>`. In roles and texts, a backslash
goes before each control string and each backslash, so that reading takes it off again. The
loss mask covers the text of assistant turns.

Turns are streamed in order within a partition: a conversation's turns are never held at once,
however many, and no conversation is split. Rows with equal conv_id and turn are all kept, by
role and text; null roles and texts are empty; null conv_id is a conversation of its own. A
conversation whose list of turns is null or empty has one row without role and text (null), no
formatted text and no turns when it is read back. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.llm.common import partitions
from rivulet.session import ship

#: Fixed values.
CONTROLS = ("<s>", "</s>", "[ROLE]", "[/ROLE]", "[INST]", "[/INST]")
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatbot": "assistant"}
LOSS_ROLE = "assistant"

_escape = re.compile("|".join(map(re.escape, ("\\", *CONTROLS))))
_unescape = re.compile(r"\\(.)", re.S)
_token = re.compile(r"\\.|" + "|".join(map(re.escape, CONTROLS[:4])), re.S)


@dataclass(frozen=True)
class Mapping:
    """rows: the table has a row for each turn. turns: the list of turns, with role and text inside. parts: (role, column) in order.

    Paths under `needs` make the layout; those under `may` can be there too.
    """

    name: str
    conv: tuple[str, ...] = ("conv_id", "id", "conversation_id")
    rows: tuple[str, str, str] | None = None
    turns: tuple[str, str, str] | None = None
    parts: tuple[tuple[str, str], ...] = ()
    may: tuple[str, ...] = field(default=())

    @property
    def needs(self) -> frozenset[str]:
        if self.rows:
            return frozenset(self.rows)
        if self.turns:
            top, role, text = self.turns
            return frozenset((f"{top}[].{role}", f"{top}[].{text}"))
        return frozenset(c for _, c in self.parts) - frozenset(self.may)


#: By priority: where a table has the paths of several, the first holds.
MAPPINGS = (
    Mapping("messages", turns=("messages", "role", "content")),
    Mapping("conversations", turns=("conversations", "from", "value")),
    Mapping("turn rows", rows=("turn", "role", "text")),
    Mapping("instruction", parts=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")), may=("system", "input")),
    Mapping("prompt and response", parts=(("system", "system"), ("user", "prompt"), ("assistant", "response")), may=("system",)),
    Mapping("prompt and completion", parts=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("question and answer", parts=(("user", "question"), ("assistant", "answer"))),
)
KNOWN = frozenset(p for m in MAPPINGS for p in (m.needs | set(m.may)))


def paths(kind: T.DataType, at: str = "") -> set[str]:
    """The nested field paths of a type; `[]` marks a list."""
    if isinstance(kind, T.StructType):
        return {p for f in kind.fields for p in paths(f.dataType, f"{at}.{f.name}" if at else f.name)}
    if isinstance(kind, T.ArrayType):
        return paths(kind.elementType, f"{at}[]")
    return {at}


def fingerprint(found: set[str] | frozenset[str]) -> str:
    return hashlib.sha256("\n".join(sorted(found & KNOWN)).encode()).hexdigest()


def _registry() -> dict[str, Mapping]:
    out: dict[str, Mapping] = {}
    for m in MAPPINGS:
        extra = sorted(m.may)
        for bits in range(1 << len(extra)):
            out.setdefault(fingerprint(m.needs | {p for i, p in enumerate(extra) if bits >> i & 1}), m)
    return out


REGISTRY = _registry()


def select_mapping(schema: T.StructType) -> Mapping:
    """The mapping of the schema's fingerprint; a schema that mixes known paths is reduced to those of the first mapping that it satisfies."""
    found = paths(schema)
    if m := REGISTRY.get(fingerprint(found)):
        return m
    for m in MAPPINGS:
        if m.needs <= found:
            return REGISTRY[fingerprint(m.needs | (found & set(m.may)))]
    raise ValueError(f"no mapping for the field paths {sorted(found)}")


def canonical_turns(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of any known layout; roles of turn rows stay as they are. Without an id column, a hash of the row's mapped columns is the id."""
    m = select_mapping(df.schema)
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    known = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    role = lambda c: F.coalesce(F.element_at(known, F.lower(c)), F.lower(c), F.lit(""))
    used = [c for c in (m.rows or ((m.turns[0],) if m.turns else [c for _, c in m.parts])) if c in df.columns]
    key = next((F.col(c).cast("long") for c in m.conv if c in df.columns), F.xxhash64(*used))
    if m.rows:
        turn, r, t = (F.col(c) for c in m.rows)
        return df.select(key.alias("conv_id"), turn.cast("long").alias("turn"), text(r).alias("role"), text(t).alias("text"))
    if m.turns:
        top, r, t = m.turns
        items: Column = F.transform(F.col(top), lambda x: F.struct(role(x[r]).alias("role"), text(x[t]).alias("text")))
    else:
        parts = [F.struct(F.lit(r).alias("role"), text(F.col(c)).alias("text")) for r, c in m.parts if c in df.columns]
        optional = [c in m.may for _, c in m.parts if c in df.columns]
        kept = [F.when(x["text"] != "", x) if may else x for x, may in zip(parts, optional, strict=True)]
        items = F.array_compact(F.array(*kept))
    out = df.select(key.alias("conv_id"), F.posexplode_outer(items).alias("turn", "x"))
    return out.select("conv_id", F.col("turn").cast("long").alias("turn"), "x.role", "x.text")


def escape(text: str) -> str:
    return _escape.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _unescape.sub(r"\1", text)


def write_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn and the span of its text there."""
    head = f"<s>[ROLE]{escape(role)}[/ROLE]"
    body = escape(text)
    return f"{head}{body}</s>", len(head), len(head) + len(body)


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """The (role, text) of each turn in formatted text, told from the template's marks alone."""
    start, role = 0, ""
    for m in _token.finditer(formatted):
        if m[0] in ("<s>", "[ROLE]"):
            start = m.end()
        elif m[0] == "[/ROLE]":
            role, start = unescape(formatted[start : m.start()]), m.end()
        elif m[0] == "</s>":
            yield role, unescape(formatted[start : m.start()])


SEGMENTS = "conv_id long, seq long, segment string, at long, loss_start long, loss_end long"


def format_turns(turns: DataFrame) -> DataFrame:
    """A row for each turn, in order within its partition: the formatted segment, its place `at` in the conversation's formatted text, and the loss span there (null for none).

    A conversation's formatted text is its segments one after another.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seq, at = object(), 0, 0
        for batch in batches:
            out = []
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv != now:
                    now, seq, at = conv, 0, 0
                segment, a, b = write_turn(role, text) if role is not None else ("", 0, 0)
                loss = (at + a, at + b) if role == LOSS_ROLE else (None, None)
                out.append((conv, seq, segment, at, *loss))
                seq, at = seq + 1, at + len(segment)
            columns = [*zip(*out, strict=True)] or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in SEGMENTS.split(", ")])

    n = partitions(turns.sparkSession)
    rows = turns.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(run, SEGMENTS)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(segments: DataFrame) -> DataFrame:
    """What reading the formatted segments back gives for each conversation; they must come as format_turns() leaves them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = [x.split()[0] for x in DIGEST.split(", ")]
        table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([*zip(*rows, strict=True)] or [[]] * 6, kinds, strict=True)], names=names)
        now = None  # conv_id, turns, hash of turns, characters under the mask, hash of them, characters
        closed = lambda s: (s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5])
        for batch in batches:
            out = []
            for conv, _, segment, at, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        out.append(closed(now))
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in read_turns(segment):
                    now[1] += 1
                    now[2].update(f"{role}\n{text}\n".encode())
                if a is not None:
                    plain = unescape(segment[a - at : b - at])
                    now[3] += len(plain)
                    now[4].update(plain.encode())
                now[5] += len(segment)
            yield table(out)
        if now is not None:
            yield table([closed(now)])

    return segments.mapInArrow(run, DIGEST)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: all conversations and conversation -7, which comes as a list of messages, formatted and read back."""
    said = "</s>[INST] ok [/INST]"
    more = ship(spark).createDataFrame([(-7, [("user", said), ("assistant", said)])], "conv_id long, messages array<struct<role:string,content:string>>")
    turns = canonical_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")).unionByName(canonical_turns(more))
    return digests(format_turns(turns))


SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(regexp_replace(text, '\\|<s>|</s>|\[/?ROLE\]|\[/?INST\]', '\\\0', 'g')) + length(role) + 20 AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
