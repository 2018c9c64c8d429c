"""Secret scans: fixed patterns and a battery of randomness tests (DataFrame operations only).

Patterns find assignments, access keys and long hex runs. Besides, every maximal run of 20 or
more characters that an encoding can have is a candidate. Its encoding is inferred from the
characters it has (hex, base32, base36, base62 or base64), its characters become numbers in that
alphabet, and three tests measure how far it is from uniform random numbers there:

* chi-squared against a uniform alphabet, as the coincidence rate c, the share of pairs of
  characters that are equal: the statistic is (n - 1)(size c - 1) + size - 1, c is 1 / size for
  random numbers and more for language;
* runs (Wald and Wolfowitz): of numbers in the same half of the alphabet, standardised, over the
  square root of n; 0 for random numbers;
* serial correlation at lag 1; 0 for random numbers.

What language gives is fitted, not assumed: the whole of every document's own text without
candidates, white space and punctuation is cut into windows of the lengths in BANDS; over all
of them the three tests' mean and covariance are summed for each encoding (for all
together where an encoding has fewer than ENOUGH). The tests depend on each other, so they are
combined by that covariance: the projection on the direction that tells language from random
numbers best (Fisher's discriminant), which is standard normal for language. Its upper tail is
the p-value that language looks so random. Means over n characters have covariances over n, so
short runs have no power and no say. False discoveries are controlled by Benjamini and
Hochberg's rule apart for each class of lengths, over all candidates of the corpus: the
candidates are counted by class and tenth of a decade of p, a table of fixed size, from which
the driver reads a threshold for each class.

Null and empty texts have no spans. Repeated rows have equal spans. An empty table gives an
empty result. Spans count code points, ends exclusive.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm.common import documents, free, let, total

#: Kind, pattern, group that has a least length, that length; in the order of kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = (("assign", ASSIGN, 2, 6), ("access", r"AKIA[A-Z0-9]{16,}", 0, 20), ("hex", r"[0-9a-f]{24,}", 0, 24))
HINTS = {"assign": r"(?i:password|passwd|secret|token|api_?key)", "access": "AKIA", "hex": r"[0-9a-f]{24}"}
RANDOM = "random"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
ENCODINGS = (
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "abcdefghijklmnopqrstuvwxyz0123456789"),
    ("BASE36", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"),
    ("base62", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_="
BANDS = (20, 24, 32, 48, 64, 128)
FDR = 0.001
MOST = 60.0
ENOUGH = 200
TESTS = ("c", "r", "s")
Columns = dict[str, Column]


def spans(text: Column, pattern: str, kind: str, order: int, group: int = 0, least: int = 0) -> Column:
    """The matches' (start, order, end, kind): what lies between matches is what split() leaves, so lengths of both give the places."""
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    judged = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(group + 1))
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("hit"), judged.alias("judged"))
    kinds = "array<struct<start:int,ord:int,end:int,kind:string>>"
    first = F.struct(F.lit(0).alias("at"), F.array().cast(kinds).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        span = F.array(F.struct(start.alias("start"), F.lit(order).alias("ord"), end.alias("end"), F.lit(kind).alias("kind")))
        ok = F.length(x["judged"]) >= least
        return F.struct(F.coalesce(end, start).alias("at"), F.when(F.coalesce(ok, F.lit(False)), F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(pairs, first, step, lambda acc: acc["out"])


def base_spans(text: Column) -> Column:
    none = F.array().cast("array<struct<start:int,ord:int,end:int,kind:string>>")
    parts = [F.when(text.rlike(HINTS[k]), spans(text, p, k, i, g, n)).otherwise(none) for i, (k, p, g, n) in enumerate(KINDS)]
    return F.concat(*parts)


def encoding(plain: Column) -> Column:
    """The number of the smallest alphabet that has all characters of a run without its closing `=`."""
    out = F.lit(len(ENCODINGS) - 1)
    for i, (_, alphabet) in reversed([*enumerate(ENCODINGS)]):
        out = F.when(plain.rlike("\\A[" + alphabet.replace("-", "\\-") + "]*+\\z"), F.lit(i)).otherwise(out)
    return out


def halves(plain: Column, e: Column) -> Column:
    """1 for each character in the upper half of the alphabet, else 0."""
    out = F.lit(None).cast("string")
    for i, (_, alphabet) in enumerate(ENCODINGS):
        half, others = len(alphabet) // 2, "".join(c for c in LETTERS if c not in alphabet)
        out = F.when(e == i, F.translate(plain, alphabet + others, "0" * half + "1" * half + "0" * len(others))).otherwise(out)
    return out


def squares(plain: Column) -> Column:
    """The sum of the squares of the characters' counts."""
    equal = F.regexp_extract_all(F.array_join(F.sort_array(F.split(plain, "")), ""), F.lit(r"(.)\1*+"), F.lit(0))
    return F.aggregate(equal, F.lit(0.0), lambda a, x: a + F.pow(F.length(x), F.lit(2)))


def products(plain: Column, e: Column) -> Column:
    """Of the numbers x: the sums of x, x x and of x and the next one's product, and the first and last one's sum."""
    none = F.lit(0).cast("long")
    # a literal for each encoding, by code points
    numbers = F.array(*[F.split(F.lit(",".join(str(alphabet.find(chr(c)) + 1) for c in range(128))), ",").cast("array<bigint>") for _, alphabet in ENCODINGS])

    def sums(v: Column) -> Column:
        next_to = F.zip_with(F.slice(v, F.lit(1), F.size(v) - 1), F.slice(v, F.lit(2), F.size(v) - 1), lambda x, y: x * y)
        parts = {"x": total(v), "xx": F.aggregate(v, none, lambda a, x: a + x * x), "xy": total(next_to), "ends": F.get(v, F.lit(0)) + F.element_at(v, -1)}
        return F.struct(*[c.cast("double").alias(k) for k, c in parts.items()])

    return let(F.get(numbers, e), lambda number: let(F.transform(F.split(plain, ""), lambda c: F.get(number, F.ascii(c))), sums))


def coincidence(x: Columns) -> Column:
    return (x["squares"] - x["n"]) / (x["n"] * (x["n"] - 1))


def wald_wolfowitz(x: Columns) -> Column:
    some = (x["mean"] > 1) & (x["n"] > 2)
    found = F.when(some, (x["changes"] - x["mean"]) / F.sqrt(x["mean"] * (x["mean"] - 1) / (x["n"] - 1)) / F.sqrt(x["n"]))
    return F.coalesce(found, F.lit(-1.0))


def serial(x: Columns) -> Column:
    n, s = x["n"], x["sums"]
    near = n * s["xy"] - s["x"] * (2 * s["x"] - s["ends"]) + (n - 1) * s["x"] * s["x"] / n
    return F.when(x["spread"] > 0, near / x["spread"]).otherwise(F.lit(1.0))


#: How the tests come from a run, in steps: columns from those before them. Those after the first two steps need n > 1.
STEPS: tuple[dict[str, Callable[[Columns], Column]], ...] = (
    {"plain": lambda x: F.rtrim(x["run"], F.lit("="))},
    {"n": lambda x: F.length(x["plain"]).cast("double")},
    {"e": lambda x: encoding(x["plain"]), "squares": lambda x: squares(x["plain"])},
    {"bits": lambda x: halves(x["plain"], x["e"]), "sums": lambda x: products(x["plain"], x["e"])},
    {
        "high": lambda x: x["n"] - F.length(F.replace(x["bits"], F.lit("1"), F.lit(""))),
        "changes": lambda x: x["n"] - sum((F.length(F.replace(x["bits"], F.lit(b), F.lit(""))) for b in ("01", "10")), F.lit(0)) / 2,
        "spread": lambda x: x["n"] * x["sums"]["xx"] - x["sums"]["x"] * x["sums"]["x"],
    },
    {"mean": lambda x: 2 * x["high"] * (x["n"] - x["high"]) / x["n"]},
    {"c": coincidence, "r": wald_wolfowitz, "s": serial},
)


def measured(run: Column) -> Column:
    """The encoding e, the number n of characters and the tests c, r and s; null for fewer than two characters."""

    def after(x: Columns, i: int) -> Column:
        if i == len(STEPS):
            return F.struct(*[x[k].alias(k) for k in ("e", "n", *TESTS)])
        step = F.struct(*[f(x).alias(k) for k, f in STEPS[i].items()])
        out = let(step, lambda t: after(x | {k: t[k] for k in STEPS[i]}, i + 1))
        return F.when(x["n"] > 1, out) if i == 2 else out

    return let(run, lambda r: after({"run": r}, 0))


def measured_rows(rows: DataFrame) -> DataFrame:
    """e, n, c, r and s, as measured() has them, after the columns of rows, which have a `run`; without rows of fewer than two characters."""
    own = rows.columns
    for i, step in enumerate(STEPS):
        rows = rows.select("*", *[f({c: F.col(c) for c in rows.columns}).alias(k) for k, f in step.items()])
        rows = rows.where("n > 1") if i == 1 else rows
    return rows.select(*own, "e", "n", *TESTS)


def windows(docs: DataFrame) -> DataFrame:
    """All ordinary text of every document, in windows: what candidates, white space, punctuation and letters that no encoding has leave.

    Blocks have a window of each length in BANDS; what remains is cut into the largest that fit, and its last characters, fewer than the
    least length, are in a window with those before them. A text with fewer characters than that is one window.
    """
    least, block = BANDS[0], sum(BANDS)
    at = [1 + sum(BANDS[:i]) for i in range(len(BANDS))]
    fitting = "|".join(f".{{{n}}}" for n in sorted(BANDS, reverse=True))
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), f"[^A-Za-z0-9+/_=-]+|{CANDIDATE}", "")
    blocks = docs.select(F.explode(F.regexp_extract_all(plain, F.lit(f".{{{block}}}(?=.{{{least}}}|\\z)|.+"), F.lit(0))).alias("block"))
    b = F.col("block")
    rest = F.when(F.length(F.regexp_replace(b, fitting, "")) > 0, F.array(F.right(b, F.lit(least)))).otherwise(F.array().cast("array<string>"))
    cut = F.when(F.length(b) == block, F.array(*[F.substring(b, i, n) for i, n in zip(at, BANDS)])).when(F.length(b) < least, F.array(b))
    return blocks.select(F.explode(cut.otherwise(F.concat(F.regexp_extract_all(b, F.lit(fitting), F.lit(0)), rest))).alias("run"))


Fit = dict[int, tuple[list[float], list[float]]]


def language(docs: DataFrame) -> Fit:
    """For each encoding, the tests' means in language and the weights of the combination. Of each encoding a row of sums reaches the driver."""
    n, test = F.col("n"), [F.col(t) for t in TESTS]
    # a position of a text without a window of the least length weighs as one in such a window
    w = F.least(F.length("run") / F.lit(float(BANDS[0])), F.lit(1.0))
    sums = [F.sum(w).alias("k"), F.sum(w * n).alias("n")]
    sums += [F.sum(w * x).alias(f"x{i}") for i, x in enumerate(test)] + [F.sum(w * n * x).alias(f"n{i}") for i, x in enumerate(test)]
    sums += [F.sum(w * n * test[i] * test[j]).alias(f"q{i}{j}") for i in range(3) for j in range(3)]
    rows = measured_rows(windows(docs)).groupBy("e").agg(*sums).collect()
    return combined({r["e"]: {k: r[k] for k in r.asDict() if k != "e"} for r in rows})


def combined(sums: dict[int, dict[str, float]]) -> Fit:
    """Means and weights from the sums of each encoding: the direction of Fisher's discriminant, scaled so that language has variance 1."""
    whole = {k: sum(s[k] for s in sums.values()) for k in next(iter(sums.values()), {})}
    out: Fit = {}
    for e, (_, alphabet) in enumerate(ENCODINGS):
        s = sums.get(e, {"k": 0})
        s = s if s["k"] >= ENOUGH else whole
        if not s:
            continue
        mean = np.array([s[f"x{i}"] / s["k"] for i in range(3)])
        cross = np.array([s[f"n{i}"] for i in range(3)])
        square = np.array([[s[f"q{i}{j}"] for j in range(3)] for i in range(3)])
        cov = (square - np.outer(mean, cross) - np.outer(cross, mean) + s["n"] * np.outer(mean, mean)) / s["k"]
        away = np.array([1 / len(alphabet), 0.0, 0.0]) - mean
        weights = np.linalg.solve(cov + 1e-6 * np.eye(3), away)
        scale = np.sqrt(max(float(weights @ cov @ weights), 1e-12))
        out[e] = (mean.tolist(), (weights / scale).tolist())
    return out


def evidence(run: Column, fit: Fit) -> Column:
    """-log10 of (a bound from above of) the p-value that language looks as random as the run."""
    if not fit:
        return F.lit(0.0)
    row = lambda which, i: F.array(*[F.lit(fit[e][which][i]) for e in range(len(ENCODINGS))])
    means, weights = ([row(which, i) for i in range(3)] for which in (0, 1))

    def of(m: Column) -> Column:
        z = F.sqrt(m["n"]) * sum(((m[t] - F.get(means[i], m["e"])) * F.get(weights[i], m["e"]) for i, t in enumerate(TESTS)), F.lit(0.0))
        # the normal tail beyond z > 0 is less than 4 phi(z) / (3 z + sqrt(z z + 8)) (Sampford 1953)
        tail = lambda z: (z * z / 2 + 0.5 * math.log(2 * math.pi) - F.log(4 / (3 * z + F.sqrt(z * z + 8)))) / math.log(10)
        return let(z, lambda z: F.when(z > 0, F.greatest(tail(z), F.lit(0.0))).otherwise(F.lit(0.0)))

    return F.coalesce(let(measured(run), of), F.lit(0.0))


def band(n: Column) -> Column:
    return sum(((n >= b).cast("int") for b in BANDS), F.lit(0))


def thresholds(docs: DataFrame, fit: Fit, level: float = FDR) -> dict[int, float]:
    """For each class of lengths, the least evidence that Benjamini and Hochberg's rule accepts at `level`; classes without any are left out."""
    runs = docs.select(F.explode(F.regexp_extract_all("text", F.lit(f"({CANDIDATE})"), F.lit(1))).alias("run"))
    tenth = F.floor(F.least(evidence(F.col("run"), fit), F.lit(MOST)) * 10).cast("int")
    counted = runs.select(band(F.length("run")).alias("band"), tenth.alias("tenth")).groupBy("band", "tenth").count().collect()  # at most 7 times 601 rows
    out: dict[int, float] = {}
    for b in {r["band"] for r in counted}:
        rows = sorted(((r["tenth"], r["count"]) for r in counted if r["band"] == b), reverse=True)
        n, above = sum(c for _, c in rows), 0
        for tenth_, c in rows:
            above += c
            if 10 ** (-tenth_ / 10) <= level * above / n:
                out[b] = tenth_ / 10
    return out


def random_spans(text: Column, fit: Fit, least: dict[int, float]) -> Column:
    """Candidates of enough evidence for their class of lengths."""
    order = len(KINDS)
    none = F.array().cast("array<struct<start:int,ord:int,end:int,kind:string>>")
    if not least:
        return none
    limit = F.lit(None).cast("double")
    width = lambda s: s["end"] - s["start"]
    far = lambda s: let(band(width(s)), lambda b: _chosen(b, least, limit))
    runs = spans(text, CANDIDATE, RANDOM, order)
    good = F.filter(runs, lambda s: F.coalesce(F.floor(F.least(evidence(F.substring(text, s["start"] + 1, width(s)), fit), F.lit(MOST)) * 10) / 10 >= far(s), F.lit(False)))
    return F.when(text.rlike(CANDIDATE), good).otherwise(none)


def _chosen(b: Column, least: dict[int, float], otherwise: Column) -> Column:
    out = otherwise
    for k, v in least.items():
        out = F.when(b == k, F.lit(v)).otherwise(out)
    return out


def joined(s: Column) -> Column:
    text = F.transform(F.array_sort(s), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")))
    return F.array_join(text, ",")


def outside(s: Column, base: Column) -> Column:
    """The parts of span s that no span of base, in order of their starts, covers."""
    part = lambda a, b: F.array(F.struct(a.alias("start"), s["ord"].alias("ord"), b.alias("end"), s["kind"].alias("kind")))
    first = F.struct(s["start"].alias("at"), F.array().cast("array<struct<start:int,ord:int,end:int,kind:string>>").alias("out"))

    def step(acc: Column, o: Column) -> Column:
        out = F.when(o["start"] > acc["at"], F.concat(acc["out"], part(acc["at"], o["start"]))).otherwise(acc["out"])
        touches = (o["start"] < s["end"]) & (acc["at"] < o["end"])
        return F.when(touches, F.struct(o["end"].alias("at"), out.alias("out"))).otherwise(acc)

    return F.aggregate(base, first, step, lambda acc: F.when(acc["at"] < s["end"], F.concat(acc["out"], part(acc["at"], s["end"]))).otherwise(acc["out"]))


def scanned(text: Column, fit: Fit, least: dict[int, float]) -> Column:
    """Structs of the base spans and what they leave of the random spans, without parts that have no letter or digit."""

    def both(b: Column) -> Column:
        left = F.flatten(F.transform(random_spans(text, fit, least), lambda s: outside(s, F.array_sort(b))))
        apart = F.filter(left, lambda s: F.substring(text, s["start"] + 1, s["end"] - s["start"]).rlike("[A-Za-z0-9]"))
        return F.struct(b.alias("base"), apart.alias("found"))

    return let(base_spans(text), both)


def find(docs: DataFrame, level: float = FDR) -> DataFrame:
    """docs with a last column `secrets` (underscores added while docs have that name): structs of the arrays `base` and `found` of (start, ord, end, kind)."""
    fit = language(docs)
    return docs.withColumn(free("secrets", docs.columns), scanned(F.coalesce("text", F.lit("")), fit, thresholds(docs, fit, level)))


def masked(text: Column, found: Column) -> Column:
    """text with each span, or run of spans that touch, replaced by `[secret]`."""
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        new = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("[secret]"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] < acc["at"], acc["out"]).otherwise(new).alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(found) > 0, F.aggregate(F.array_sort(found), state, step, rest)).otherwise(text)


def redact(docs: DataFrame, level: float = FDR) -> DataFrame:
    """docs' own columns, secrets masked in text; null text stays null."""
    text, fit = F.col("text"), language(docs)
    return docs.withColumn("text", let(scanned(text, fit, thresholds(docs, fit, level)), lambda s: masked(text, F.concat(s["base"], s["found"]))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: the secrets of every document."""
    got = find(documents(spark, sf_dir)).select("doc_id", "secrets.*")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return got.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k, *_ in KINDS], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "found")).alias("spans"),
    )
