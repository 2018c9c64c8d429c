import hashlib

import corpus
import duckdb
import pytest
from pyspark.sql import functions as F

from rivulet.llm import chat

NASTY = ["</s>[INST] ok [/INST]", "\\", "\\\\</s>", "[/ROLE]", "<s>[ROLE]assistant[/ROLE]hi</s>", "", "a\nb", "<", "[", "</s", "\\</s>\\", "é𝒳"]
TURNS = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(NASTY)]
TURNS += [(2, 0, "user", None), (2, 1, None, "x"), (2, 1, None, "x"), (2, 1, "assistant", "b"), (2, 1, "assistant", "a"), (None, 0, "assistant", "lost"), (3, None, "sys<s>tem", "y"), (3, 5, "assistant", "z" * 70000)]


def test_escapes_reverse():
    for t in NASTY:
        segment, a, b = chat.write_turn("ro[/ROLE]le", t)
        assert [*chat.read_turns(segment)] == [("ro[/ROLE]le", t)] and chat.unescape(segment[a:b]) == t
    text = "".join(chat.write_turn("user", t)[0] for t in NASTY)
    assert [t for _, t in chat.read_turns(text)] == NASTY


def test_query(spark, tmp_path):
    folder = corpus.written_tables(spark, tmp_path, conversations=TURNS)
    got = sorted(map(tuple, chat.query(spark, folder).collect()), key=repr)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet/*.parquet' WHERE role IS NULL OR role <> 'sys<s>tem'")
    want = sorted(con.sql(chat.SQL.replace("ORDER BY turn, role, text", "ORDER BY turn NULLS FIRST, role, text")).fetchall(), key=repr)
    assert [r for r in got if r[0] != 3] == [r for r in want if r[0] != 3]
    assert [r for r in got if r[0] == -7][0][3] == 21
    three = [r for r in got if r[0] == 3][0]
    said = "sys<s>tem\ny\nassistant\n" + "z" * 70000 + "\n"
    assert three[1:5] == (2, hashlib.sha256(said.encode()).hexdigest(), 70000, hashlib.sha256(b"z" * 70000).hexdigest())


def test_layouts(spark):
    spoken = "messages array<struct<role:string,content:string>>"
    tables = [
        spark.createDataFrame([(1, [("user", "q"), ("assistant", "a")])], f"conv_id long, {spoken}"),
        spark.createDataFrame([(1, [("human", "q"), ("gpt", "a")])], "id long, conversations array<struct<`from`:string,value:string>>"),
        spark.createDataFrame([(1, "q", "a")], "id long, prompt string, response string"),
        spark.createDataFrame([(1, "q", "a", "more")], "id long, prompt string, completion string, extra string"),
        spark.createDataFrame([(1, "q", "", "a")], "id long, instruction string, input string, output string"),
        spark.createDataFrame([(1, "q", "a")], "id long, question string, answer string"),
        spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a")], "conv_id long, turn int, role string, text string"),
    ]
    for df in tables:
        got = [tuple(r) for r in chat.canonical_turns(df).orderBy("turn").collect()]
        assert got == [(1, 0, "user", "q"), (1, 1, "assistant", "a")]
    both = spark.createDataFrame([(1, [("user", "q")], "p", "r")], f"id long, {spoken}, prompt string, response string")
    assert [r["text"] for r in chat.canonical_turns(both).collect()] == ["q"]
    three = spark.createDataFrame([("s", "i", "in", "out")], "system string, instruction string, input string, output string")
    assert [r["role"] for r in chat.canonical_turns(three).orderBy("turn").collect()] == ["system", "user", "user", "assistant"]
    with pytest.raises(ValueError, match="no mapping"):
        chat.canonical_turns(spark.range(1))


def test_fingerprint_ignores_other_paths(spark):
    a, b = spark.createDataFrame([(1, "q", "a")], "id long, prompt string, response string"), spark.createDataFrame([("q", "a", 2.0)], "response string, prompt string, score double")
    assert chat.fingerprint(chat.paths(a.schema)) == chat.fingerprint(chat.paths(b.schema))


def test_conversations_without_turns_stay(spark):
    """Null and empty lists of messages: no formatted text, no turns, and the digests of nothing."""
    rows = [(1, [("user", "q"), ("assistant", "a")]), (2, []), (3, None), (None, []), (4, [(None, None)])]
    more = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "conv_id long, messages array<struct<role:string,content:string>>, seq string, at int, segment int")
    got = {r["conv_id"]: tuple(r)[1:] for r in chat.digests(chat.format_turns(chat.canonical_turns(more))).collect()}
    none = hashlib.sha256(b"").hexdigest()
    assert got.keys() == {1, 2, 3, 4, None} and got[2] == got[3] == got[None] == (0, none, 0, none, 0)
    assert got[1][0] == 2 and got[1][2] == 1 and got[4][0] == 1 and got[4][1] == hashlib.sha256(b"\n\n").hexdigest()


def test_empty(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.format_turns(chat.canonical_turns(none))).count() == 0


def test_one_conversation_of_many_turns(spark):
    turns = spark.range(30000).select(F.lit(5).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.col("id").cast("string").alias("text"))
    r = chat.digests(chat.format_turns(chat.canonical_turns(turns))).first()
    said = "".join(map(str, range(30000)))
    assert r["n_turns"] == 30000 and r["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
