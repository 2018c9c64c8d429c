import random
import re

import corpus
import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rivulet.llm import neardup, words

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    ws = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if len(ws) >= k else {tuple(ws)} - {()}


def brute(texts, k, percent):
    sets = {}
    for i, t in texts:
        sets.setdefault(i, []).append(shingles(t, k))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    items = [(i, s) for i, all_ in sets.items() for s in all_]
    for a, s in items:
        for b, t in items:
            if a < b and s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i)) for i, s in items)


def variants(n, seed, length=200, edits=6):
    draw, out = random.Random(seed), []
    base = corpus.words(length, seed, 5000).split()
    for _ in range(n):
        ws = list(base)
        for _ in range(draw.randrange(edits)):
            at = draw.randrange(len(ws))
            ws[at : at + 1] = draw.choice([[], ["new", f"word{draw.random()}"], [f"v{draw.random()}"]])
        out.append(" ".join(ws))
    return out


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_against_brute_force(spark, k, percent):
    texts = [(i, t) for i, t in corpus.TEXTS if i != 17]
    for seed in range(8):
        texts += [(100 + 20 * seed + i, t) for i, t in enumerate(variants(12, seed, 20 + 40 * seed))]
    got = sorted(tuple(r) for r in neardup.classes(corpus.clashing(corpus.documents(spark, texts)), k, percent).collect())
    assert got == brute(texts, k, percent)
    assert len({r[2] for r in got}) < len(got) - 30


def test_links_at_the_threshold(spark):
    """Pairs of sets of a size that share just enough, or one too few."""
    texts = []
    for seed in range(30):
        ws = corpus.words(103, 1000 + seed, 100000).split()  # 100 shingles of 4
        texts.append((2 * seed, " ".join(ws)))
        texts.append((2 * seed + 1, " ".join(ws[: 92 + 3 + seed % 2 * -1] + corpus.words(8, 5000 + seed, 100000).split())))
    got = sorted(tuple(r) for r in neardup.classes(corpus.documents(spark, texts), 4, 85).collect())
    assert got == brute(texts, 4, 85)


def test_long_chains(spark):
    """Each text is like the next and unlike the rest, so that one component has many links in a row."""
    ws = corpus.words(600, 77, 100000).split()
    texts = [(i, " ".join(ws[6 * i : 6 * i + 120])) for i in range(60)]
    got = sorted(tuple(r) for r in neardup.classes(corpus.documents(spark, texts), 4, 85).collect())
    assert got == brute(texts, 4, 85) and {r[2] for r in got} == {0}


def test_components(spark):
    draw = random.Random(3)
    edges = [(draw.randrange(400), draw.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(90)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = dict(map(tuple, neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_nulls_repeats_and_empty_tables(spark):
    texts = [(None, corpus.BASE), (3, corpus.BASE), (None, None), (4, corpus.BASE), (4, corpus.BASE), (5, None)]
    got = sorted((tuple(r) for r in neardup.classes(corpus.documents(spark, texts), 4, 85).collect()), key=repr)
    n = len(shingles(corpus.BASE, 4))
    assert got == sorted([(None, n, None), (3, n, 3), (None, 0, None), (4, n, 3), (4, n, 3), (5, 0, 5)], key=repr)
    kept = neardup.one_of_each(corpus.clashing(corpus.documents(spark, texts)), 4, 85)
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == [3, 5, None]
    assert neardup.classes(corpus.empty(spark)).count() == 0 and neardup.one_of_each(corpus.empty(spark)).count() == 0


def thue_morse(n, a, b):
    return "".join((a, b)[bin(i).count("1") & 1] for i in range(n))


@pytest.mark.parametrize("n", [8, 64, 128, 256, 1024, 4096])
def test_long_words_of_any_pattern_differ(spark, n):
    texts = [(1, thue_morse(n, "a", "b")), (2, thue_morse(n, "b", "a")), (3, "q " + thue_morse(n, "a", "b") + " r s t"), (4, "q " + thue_morse(n, "b", "a") + " r s t"), (5, thue_morse(n, "A", "b"))]
    got = sorted(tuple(r) for r in neardup.classes(corpus.documents(spark, texts), 4, 85).collect())
    assert got == brute(texts, 4, 85) and got[4][2] == 1


def test_words_hash_alike_wherever_they_lie():
    draw = random.Random(8)
    ws = ["".join(draw.choice("abcXYZé9") for _ in range(draw.choice((1, 3, 7, 8, 9, 15, 16, 17, 40, 260)))) for _ in range(300)]
    seen = {}
    for text in (" ".join(ws), "\n\t ".join(reversed(ws)), *ws):
        data = text.encode()
        got, ends = words.Words()(np.frombuffer(data, np.uint8), np.array([len(data)]))
        assert ends[-1] == len(text.split()) == len(got)
        for w, h in zip(text.translate(UP).split(), got, strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    some = ["a b", "", "c", " d  e ", ""]
    data = "".join(some).encode()
    got, ends = words.Words()(np.frombuffer(data, np.uint8), np.cumsum([len(x) for x in some]))
    assert ends.tolist() == [2, 2, 3, 5, 5]


def test_bitmaps_bound_overlaps_from_above():
    """Of sets of any sizes, whatever their bitmaps' widths; and closely enough to tell most unlike sets apart."""
    draw = np.random.default_rng(6)
    whole = draw.integers(0, 1 << 63, 60000).astype(np.uint64)
    sets = [np.unique(draw.choice(whole, n, replace=False)) for n in (0, 1, 5, 300, 511, 520, 1000, 1300, 4000, 9000, 40000)]
    maps = neardup.Bitmaps(pa.array([neardup.bitmap(s).tobytes() for s in sets], pa.binary()))
    assert {len(neardup.bitmap(s)) for s in sets} == {16, 32, 64, 256, 1024}
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    size = np.array([len(s) for s in sets])
    most = maps.most(i, maps, j, size[i], size[j])
    for a, b, got in zip(i, j, most, strict=True):
        n, m, both = size[a], size[b], len(np.intersect1d(sets[a], sets[b]))
        assert got >= both
        if a != b and 100 * min(n, m) >= 75 * max(n, m) and max(n, m) < 10000 and 100 * both < 10 * n:
            assert 185 * got < 85 * (n + m)


def test_overlap():
    draw = np.random.default_rng(2)
    for _ in range(200):
        x, y = (np.unique(draw.integers(0, 60, draw.integers(0, 50))).astype(np.uint64) for _ in range(2))
        assert neardup.overlap(x, y) == len(set(x) & set(y))


@pytest.mark.parametrize(("block", "part"), [(512, 4096), (4, 3)])
def test_all_links_however_tiles_are_cut(spark, monkeypatch, block, part):
    """All links between different sets, and the same classes, from tiles cut into blocks of any size."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "PART", part)
    texts = [(i, t) for i, t in enumerate(variants(24, 5, 200, 4) + variants(16, 6, 150, 3) + variants(8, 7, 40, 2))]
    sets = {i: shingles(t, 4) for i, t in texts}
    first = {}
    for i, s in sets.items():
        first.setdefault(frozenset(s), i)
    want = {(b, a) for a in first.values() for b in first.values() if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    assert {tuple(r) for r in neardup.links(corpus.documents(spark, texts), 4, 85).collect()} == want and len(want) > 100
    got = sorted(tuple(r) for r in neardup.classes(corpus.documents(spark, texts), 4, 85).collect())
    assert got == brute(texts, 4, 85)


def test_sql(spark, tmp_path):
    texts = [(i, t) for i, t in corpus.TEXTS if i not in (17, 13)] + [(100 + i, t) for i, t in enumerate(variants(20, 3, 50, 5))]
    folder = corpus.written_tables(spark, tmp_path, texts)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{folder}/documents.parquet/*.parquet'")
    assert sorted(con.sql(neardup.SQL).fetchall()) == brute(texts, 4, 85)


def test_rows_that_share_a_doc_id_and_rows_without_one(spark):
    a, b, c = corpus.words(100, 1), corpus.words(100, 2), corpus.words(100, 3)
    texts = [(1, a), (1, b), (1, a), (1, a.upper()), (2, c), (None, c), (None, c), (None, corpus.words(80, 9)), (None, None), (None, None), (3, b + " x")]
    kept = sorted(((r["doc_id"], (r["text"] or "").lower()) for r in neardup.one_of_each(corpus.clashing(corpus.documents(spark, texts)), 4, 85).collect()), key=repr)
    assert kept == sorted([(1, a), (1, b), (2, c), (None, corpus.words(80, 9)), (None, "")], key=repr)


def test_large_group_of_near_copies_makes_few_pairs(spark, monkeypatch):
    seen = []
    linked = neardup.linked
    monkeypatch.setattr(neardup, "linked", lambda pairs, *a: (seen.append(pairs.count()), linked(pairs, *a))[1])
    texts = [*enumerate(variants(300, 5, 300, 4))]
    got = neardup.classes(corpus.documents(spark, texts), 4, 85).agg(F.countDistinct("component_id")).first()[0]
    assert got == 1 and sum(seen) < 12 * 300
