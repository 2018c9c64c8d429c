"""Quality rules as a short-circuit cascade (DataFrame operations only).

A rule is a condition on a text that rejects it. On a sample, each rule's cost (seconds a
document) and selectivity (share rejected) are measured; the cascade runs the rules by
rejection per cost, and a document that one rule rejects is not put to the later ones. The
order changes the cost alone: the verdict is the same in any order, so the sample's size is no
limit on what is judged.

The sample is at most SAMPLE_ROWS rows of at most SAMPLE_FILES of the table's files, spread
evenly over all of them and drawn by chance within them, whatever the ids. A rule's time is the
least of RUNS runs over the sample, each row REPEATS times, less that of a job that splits the
texts and asks no rule, and counts in steps of a power of four, so that chance in the clock
seldom changes the order; rules that come out equal go by selectivity, then as listed.

Null and empty texts have no words and fail `few_words`. Repeated rows are judged alike. An
empty table gives an empty result (rules then keep their listed order). Other columns pass
through untouched.
"""

from __future__ import annotations

import math
import re
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm.common import SPACES, discard, documents, let, total, words, written

#: Fixed values.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
SAMPLE_ROWS, SAMPLE_FILES = 400, 8
REPEATS, RUNS, PARTS = 4, 3, 4


def word_chars(text: Column) -> Column:
    return F.length(F.translate(text, SPACES, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")


def n_dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def n_repeat_words(ws: Column, k: int = WINDOW) -> Column:
    """Words inside k-word windows that occur twice or more in the text, the first occurrence included.

    Windows compare by a 64-bit hash of word hashes. Texts without a repeat stop at the count of
    distinct windows; the others sort (hash, place) pairs, so long texts cost n log n.
    """

    def repeated(grams: Column) -> Column:
        pairs = F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            near = lambda e, j: F.coalesce(e["h"] == F.get(s, j)["h"], F.lit(False))
            return F.array_sort(F.transform(F.filter(s, lambda e, i: near(e, i - 1) | near(e, i + 1)), lambda e: e["i"]))

        covered = lambda at: total(F.transform(at, lambda p, i: F.least(F.lit(k), F.coalesce(F.get(at, i + 1) - p, F.lit(k)))))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(let(pairs, lambda s: let(places(s), covered)))

    def grams(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))

    hashes = F.transform(ws, lambda w: F.xxhash64(w))
    return let(hashes, lambda h: F.when(F.size(h) < k, F.lit(0).cast("long")).otherwise(let(grams(h), repeated)))


@dataclass(frozen=True)
class Rule:
    """rejects(text, words): true where the rule rejects the text."""

    name: str
    rejects: Callable[[Column, Column], Column]


def _few_words(text: Column, ws: Column) -> Column:
    return F.size(ws) < 10


def _repeats(text: Column, ws: Column) -> Column:
    return 100 * n_repeat_words(ws) > 20 * F.size(ws)


def _symbols(text: Column, ws: Column) -> Column:
    return 100 * n_symbols(text) > 10 * F.size(ws)


def _dup_lines(text: Column, ws: Column) -> Column:
    return 100 * n_dup_lines(text) > 30 * F.size(F.split(text, "\n"))


def _word_length(text: Column, ws: Column) -> Column:
    return (word_chars(text) < 2 * F.size(ws)) | (word_chars(text) > 16 * F.size(ws))


def _shouting(text: Column, ws: Column) -> Column:
    upper = F.regexp_replace(text, r"[^\p{Lu}]+", "")
    letters = F.regexp_replace(text, r"[^\p{L}]+", "")
    return 100 * F.length(upper) > 60 * F.length(letters)


#: The base rules come first; every rule is on the whole text.
RULES = (Rule("few_words", _few_words), Rule("repeats", _repeats))
MORE_RULES = (Rule("symbols", _symbols), Rule("dup_lines", _dup_lines), Rule("word_length", _word_length), Rule("shouting", _shouting))


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most `rows` texts. Of a table of many files, only SAMPLE_FILES are read; their own tasks draw the rows before any are moved."""
    files = sorted(docs.inputFiles())
    n = 0
    if len(files) > SAMPLE_FILES:
        chosen = [files[i * len(files) // SAMPLE_FILES] for i in range(SAMPLE_FILES)]
        try:
            # a path's URI is written with one slash there
            some = docs.where(F.col("_metadata.file_path").isin([*chosen, *[re.sub("^([A-Za-z0-9+.-]+):///", r"\1:/", x) for x in chosen]]))
            if n := some.count():
                docs = some
        except AnalysisException:
            pass  # not plainly a table of files: its own tasks read it, in parallel
    n = n or docs.count()
    return docs.select("text").sample(min(1.0, 1.5 * rows / max(n, 1)), 7).limit(rows)


def cascade_order(docs: DataFrame, rules: tuple[Rule, ...], rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejection per cost, most first, as measured on the sample."""
    few = written(sample(docs, rows).repartition(PARTS), "rules")
    repeated = few.select(F.coalesce("text", F.lit("")).alias("text"), F.explode(F.array_repeat(F.lit(0), REPEATS)))

    def seconds(verdict: Callable[[Column, Column], Column]) -> tuple[float, float]:
        """The least time, and the share that the verdict takes."""
        asked = repeated.agg(F.avg(let(words(F.col("text")), lambda ws: verdict(F.col("text"), ws).cast("int"))))
        best, share = math.inf, 0.0
        for _ in range(RUNS):
            began = time.perf_counter()
            share = asked.first()[0] or 0.0
            best = min(best, time.perf_counter() - began)
        return best, share

    if few.isEmpty():
        return list(rules)
    bare, _ = seconds(lambda text, ws: F.size(ws) < 0)
    rates = {}
    for rule in rules:
        spent, share = seconds(rule.rejects)
        cost = 4.0 ** round(math.log(max(spent - bare, 0.004), 4))
        rates[rule.name] = (share / cost, share)
    discard(few)
    return sorted(rules, key=lambda r: (-rates[r.name][0], -rates[r.name][1]))


def rejected(text: Column, ws: Column, order: list[Rule]) -> Column:
    """The cascade as one CASE: a branch is evaluated only where all before it passed."""
    out = F.lit(False)
    for rule in reversed(order):
        out = F.when(F.coalesce(rule.rejects(text, ws), F.lit(False)), F.lit(True)).otherwise(out)
    return out


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES + MORE_RULES) -> DataFrame:
    """docs without those that a rule rejects, each text scanned once."""
    order, text = cascade_order(docs, rules), F.coalesce("text", F.lit(""))
    return docs.where(~let(words(text), lambda ws: rejected(text, ws, order)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: the base measures of every document, and the cascade's verdict."""
    docs = documents(spark, sf_dir)
    order, text = cascade_order(docs, MORE_RULES), F.coalesce("text", F.lit(""))

    def measures(ws: Column) -> Column:
        n, repeats = F.size(ws), n_repeat_words(ws)
        failed = lambda r: (n < 10) | (100 * r > 20 * n)
        # what the base rules reject is not put to the others
        more = lambda r: F.when(failed(r), F.lit(True)).otherwise(rejected(text, ws, order))
        return let(repeats, lambda r: F.struct(n.cast("long").alias("n_words"), r.alias("n_repeat_words"), failed(r).alias("base_failed"), more(r).alias("rejected")))

    m = docs.select("doc_id", word_chars(text).alias("word_chars"), n_symbols(text).alias("n_symbols"), n_dup_lines(text).alias("n_dup_lines"), let(words(text), measures).alias("m"))
    return m.select("doc_id", "m.n_words", "word_chars", "n_symbols", "n_dup_lines", "m.n_repeat_words", "m.base_failed", (~F.col("m.rejected")).alias("kept"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, list_aggregate(ws[i:i+4], 'string_agg', ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1),
c AS (SELECT doc_id, CAST(count(DISTINCT p) AS BIGINT) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM r) GROUP BY doc_id),
m AS (SELECT w.doc_id, text, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, len(string_split(text, chr(10))) AS n_lines,
             length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS n_letters,
             coalesce(c.n, 0) AS n_repeat_words FROM w LEFT JOIN c ON w.doc_id = c.doc_id),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 30 * n_lines
         OR word_chars < 2 * n_words OR word_chars > 16 * n_words OR 100 * n_upper > 60 * n_letters) AS kept
FROM f
"""
