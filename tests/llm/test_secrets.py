import base64
import hashlib
import random
import re

import corpus
import numpy as np
import pytest

from rivulet.llm import secrets

PATTERNS = [
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
]
draw = random.Random(4)
HEX = "".join(draw.choice("0123456789abcdef") for _ in range(40))
B64 = base64.b64encode(bytes(draw.randrange(256) for _ in range(48))).decode()
TEXTS = corpus.TEXTS + [
    (100, f"é password = '{HEX[:18]}' and token:abc, token=token: longvalue123"), (101, f"key AKIA{'QX3Z' * 4} and AKIA12 AKIAAKIA{'Z9' * 9}"), (102, f"{HEX} {HEX}x{HEX[:23]}"),
    (103, f"𝒳 PASSWD=\"abcdef\" ApiKey='x-y_z.1=' api_key :  {HEX} secret=short"), (104, f"the blob {B64} is here"), (105, "Donaudampfschiffahrtsgesellschaft internationalization undsoweiterundsofort"), (106, None), (100, f"token={HEX}"),
]


def brute(text):
    out = []
    for order, (kind, pattern, group, least) in enumerate(PATTERNS):
        out += [(m.start(), order, m.end(), kind) for m in pattern.finditer(text or "") if len(m[group]) >= least]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(out)]


def test_base_spans(spark, tmp_path):
    got = secrets.query(spark, corpus.written_tables(spark, tmp_path, TEXTS)).collect()
    want = {}
    for i, t in TEXTS:
        s = brute(t)
        want.setdefault(i, []).append((*[sum(x.startswith(k) for x in s) for k in ("assign", "access", "hex")], hashlib.sha256(",".join(s).encode()).hexdigest()))
    for r in got:
        assert tuple(r)[1:5] in want[r["doc_id"]]
        assert [x for x in r["spans"].split(",") if x and not x.startswith("random")] in [brute(t) for i, t in TEXTS if i == r["doc_id"]]
    assert len(got) == len(TEXTS)


SYLLABLES = "the ing tion and ver schaft keit ment er en ion le que re con pro al ter is a o un der ar es st in to ed".split()


def language(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 4))) for _ in range(n))


LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def planted(n, seed, alphabet, size):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(size)) for _ in range(n)]


ALPHABETS = {"base62": LETTERS, "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base36": LETTERS[:26] + "0123456789", "base64": LETTERS + "+/", "base64url": LETTERS + "-_"}


def random_table():
    """Ordinary texts with tokens that no base pattern finds, with long compound words, or with neither."""
    texts, where = [], {}
    for k, (name, alphabet) in enumerate(ALPHABETS.items()):
        for i, token in enumerate(planted(30, k, alphabet, 64 if name in ("base32", "base36") else 40)):  # few letters need more of them
            at = 1000 * (k + 1) + i
            before = language(40, at)
            texts.append((at, f"{before} {token} {language(40, at + 7)}"))
            where[at] = (len(before) + 1, len(before) + 1 + len(token), name)
    compound = [(9000 + i, language(30, i) + " " + "".join(language(9, 50 + i).split()) + " " + language(30, 99 + i)) for i in range(200)]
    return texts + compound + [(20000 + i, language(120, 777 + i)) for i in range(900)], where


def test_planted_tokens_that_base_patterns_miss_are_found_and_words_are_not(spark):
    texts, where = random_table()
    got = {r["doc_id"]: r["secrets"] for r in secrets.find(corpus.documents(spark, texts)).collect()}
    assert not any(got[i]["base"] for i in where)
    hit = {i for i, (a, b, _) in where.items() if [(x["start"], x["end"]) for x in got[i]["found"]] == [(a, b)]}
    for name in ALPHABETS:
        assert sum(where[i][2] == name for i in hit) >= 27, name
    assert sum(len(s["found"]) > 0 for i, s in got.items() if i not in where) <= 2


def by_definition(run):
    """The three tests by their definitions, in numpy."""
    plain = run.rstrip("=")
    e = next(i for i, (_, alphabet) in enumerate(secrets.ENCODINGS) if set(plain) <= set(alphabet) or i == len(secrets.ENCODINGS) - 1)
    alphabet = secrets.ENCODINGS[e][1]
    v = np.array([alphabet.find(c) + 1 for c in plain])
    n, size = len(v), len(alphabet)
    count = np.bincount(v)
    chi = float(((count[count > 0] ** 2).sum()) * size / n - n)
    c = (chi - (size - 1) + n - 1) / (n - 1) / size
    high = v > size / 2
    m, k = int(high.sum()), int((high[1:] != high[:-1]).sum()) + 1
    mean = 2 * m * (n - m) / n + 1
    r = (k - mean) / np.sqrt((mean - 1) * (mean - 2) / (n - 1)) / np.sqrt(n) if mean > 2 and n > 2 else -1.0
    d = v - v.mean()
    s = float((d[1:] * d[:-1]).sum() / (d * d).sum()) if (d != 0).any() else 1.0
    return e, n, c, r, s


def test_tests_and_evidence_against_numpy(spark):
    """The tests of each run, the fit of language and the p-values, by their definitions."""
    texts, _ = random_table()
    docs = corpus.documents(spark, texts)
    fit = secrets.language(docs)
    runs = [r["run"] for r in secrets.windows(docs).collect() if r["run"] is not None]
    assert len(runs) > 900 and all(re.fullmatch("[A-Za-z0-9+/_=-]+", x) and len(x) in secrets.BANDS for x in runs)
    sums = {}
    for e, *row in map(by_definition, runs):
        sums.setdefault(e, []).append(row)
    large = max(sums, key=lambda e: len(sums[e]))
    rows = np.array(sums[large])
    n, x = rows[:, 0], rows[:, 1:]
    mean = x.mean(axis=0)
    cov = ((x - mean) * n[:, None]).T @ (x - mean) / len(x)
    away = np.array([1 / len(secrets.ENCODINGS[large][1]), 0, 0]) - mean
    w = np.linalg.solve(cov + 1e-6 * np.eye(3), away)
    w /= np.sqrt(w @ cov @ w)
    assert np.allclose(mean, fit[large][0], rtol=1e-6) and np.allclose(w, fit[large][1], rtol=1e-4)
    some = [*runs[:40], *[t for a in ALPHABETS.values() for t in planted(4, 5, a, 33)], "a" * 30, "ab" * 20, "=" * 25, "a" + "=" * 24, B64, "--------------------"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(some)], "i int, run string")
    from pyspark.sql import functions as F

    got = {r["i"]: r for r in df.select("i", secrets.measured(F.col("run")).alias("m"), secrets.evidence(F.col("run"), fit).alias("p")).collect()}
    from math import erfc, log10, sqrt

    for i, t in enumerate(some):
        if len(t.rstrip("=")) < 2:
            assert got[i]["m"] is None and got[i]["p"] == 0
            continue
        e, n, *tests = by_definition(t)
        assert (got[i]["m"]["e"], got[i]["m"]["n"]) == (e, n) and np.allclose([got[i]["m"][k] for k in secrets.TESTS], tests)
        z = sqrt(n) * float((np.array(tests) - fit[e][0]) @ np.array(fit[e][1]))
        exact = -log10(max(erfc(z / sqrt(2)) / 2, 1e-300))
        assert got[i]["p"] <= exact + 1e-9 and (z <= 0 and got[i]["p"] == 0 or z < 0.5 or got[i]["p"] > 0.9 * exact - 0.1 or exact > 290)


def cut(text):
    """The windows of a text, by their definition."""
    plain = "".join(x for x in re.findall("[A-Za-z0-9+/_=-]+", text or "") if len(x) < 20)
    out, at = [], 0
    while len(plain) - at == 316 or len(plain) - at >= 336:
        for n in secrets.BANDS:
            out, at = [*out, (at, at + n)], at + n
    while len(plain) - at >= 20:
        n = max(n for n in secrets.BANDS if n <= len(plain) - at)
        out, at = [*out, (at, at + n)], at + n
    if at < len(plain):
        out.append((max(len(plain) - 20, 0), len(plain)))
    assert {x for a, b in out for x in range(a, b)} == {*range(len(plain))} and sum(b - a for a, b in out) < len(plain) + 20
    return [plain[a:b] for a, b in out]


def test_language_is_fitted_on_all_ordinary_text(spark):
    """Every position of every text is in a window, and the fit is that of all windows."""
    sizes = [0, 1, 2, 3, 19, 20, 21, 39, 127, 128, 315, 316, 317, 335, 336, 337, 632, 651, 652, 5000]
    alone = [(i, " ".join(re.findall(".{1,7}", "".join(language(n, i).split())[:n]))) for i, n in enumerate(sizes)]
    texts = corpus.TEXTS + TEXTS[-8:] + alone + [(900 + i, language(150, i)) for i in range(40)] + [(950, f"{language(60, 1)} {B64}, {language(60, 2)}é{B64}")]
    docs = corpus.documents(spark, texts)
    want = sorted(x for _, t in texts for x in cut(t))
    assert sorted(r["run"] for r in secrets.windows(docs).collect()) == want
    rows = [(min(len(x) / 20, 1.0), *by_definition(x)) for x in want if len(x.rstrip("=")) > 1]
    large = max({r[1] for r in rows}, key=lambda e: sum(r[1] == e for r in rows))
    x = np.array([r for r in rows if r[1] == large])
    mean = x[:, 0] @ x[:, 3:] / x[:, 0].sum()
    cov = ((x[:, 3:] - mean) * (x[:, 0] * x[:, 2])[:, None]).T @ (x[:, 3:] - mean) / x[:, 0].sum()
    w = np.linalg.solve(cov + 1e-6 * np.eye(3), np.array([1 / len(secrets.ENCODINGS[large][1]), 0, 0]) - mean)
    fit = secrets.language(docs)[large]
    assert np.allclose(fit[0], mean, rtol=1e-6) and np.allclose(fit[1], w / np.sqrt(w @ cov @ w), rtol=1e-4)
    assert secrets.language(corpus.documents(spark, [(i, f"key no {i}") for i in range(9)]))


def test_thresholds_against_benjamini_and_hochberg(spark):
    texts, _ = random_table()
    docs = corpus.documents(spark, texts)
    fit = secrets.language(docs)
    from pyspark.sql import functions as F

    runs = docs.select(F.explode(F.regexp_extract_all("text", F.lit(f"({secrets.CANDIDATE})"), F.lit(1))).alias("run"))
    by_band = {}
    for r in runs.select(F.length("run").alias("n"), secrets.evidence(F.col("run"), fit).alias("p")).collect():
        by_band.setdefault(sum(r["n"] >= b for b in secrets.BANDS), []).append(int(min(r["p"], secrets.MOST) * 10 + 1e-9) / 10)
    want = {}
    for b, found in by_band.items():
        ordered = sorted(found, reverse=True)
        accepted = [x for k, x in enumerate(ordered, 1) if 10**-x <= secrets.FDR * sum(y >= x for y in ordered) / len(ordered)]
        if accepted:
            want[b] = min(accepted)
    assert secrets.thresholds(docs, fit) == pytest.approx(want) and want


def test_masking(spark):
    docs = corpus.clashing(corpus.documents(spark, [(1, f"a {HEX} b AKIA{'QX3Z' * 4}!"), (2, None), (3, "clean"), (4, f"token={HEX}")]))
    out = secrets.redact(docs)
    assert out.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: "a [secret] b [secret]!", 2: None, 3: "clean", 4: "[secret]"}


def test_empty_and_no_python(spark, tmp_path):
    assert secrets.find(corpus.empty(spark)).count() == 0
    plan = secrets.query(spark, corpus.written_tables(spark, tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_what_base_spans_leave_of_a_random_run(spark):
    rng = random.Random(3)
    access, token = "AKIA" + "QX3Z" * 4, "".join(rng.choice("ghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(60))
    texts = [(1, f"a {access}/{token} b"), (2, f"a {HEX}_{token} b"), (3, f"a {token}-{HEX} b"), (4, f"a {token} b"), (5, f"a {HEX}-{HEX} b")]
    docs = corpus.documents(spark, texts + random_table()[0])
    got = {r["doc_id"]: r["secrets"] for r in secrets.find(docs).where("doc_id < 6").collect()}
    for i, t in texts:
        covered = {x for s in [*got[i]["base"], *got[i]["found"]] for x in range(s["start"], s["end"])}
        assert all(x in covered for part in (access, token, HEX) if part in t for x in range(t.index(part), t.index(part) + len(part)))
        assert not any(a["start"] < b["end"] and b["start"] < a["end"] for a in got[i]["base"] for b in got[i]["found"])
    assert [(s["start"], s["end"]) for s in got[1]["found"]] == [(22, 83)] and not got[5]["found"]
    assert not any(token in r["text"] or HEX in r["text"] for r in secrets.redact(docs).where("doc_id < 6").collect())


def test_columns_of_the_same_names_stay(spark):
    docs = corpus.clashing(corpus.documents(spark))
    got = secrets.find(docs)
    assert got.columns == [*docs.columns, "secrets_"] and got.select("base", "found", "secrets").distinct().collect() == [("other", "other", "other")]
