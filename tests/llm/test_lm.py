import random

import corpus
import numpy as np
import pytest
from pyspark.sql import functions as F

from rivulet.llm import lm
from rivulet.llm.words import Words


def chained(n, seed):
    """Words of which each tells the next."""
    draw = random.Random(seed)
    at, out = draw.randrange(40), []
    for _ in range(n):
        out.append(f"c{at}")
        at = (at * 7 + draw.choice((1, 2))) % 40
    return " ".join(out)


def hashes(text):
    data = np.frombuffer((text or "").encode(), np.uint8)
    return Words()(data, np.array([len(data)]))[0]


def model(spark, docs, rounds=lm.ROUNDS):
    counts = lm.word_counts(docs)
    vocab, least = lm.vocabulary(counts)
    return counts, vocab, least, lm.train(docs, vocab, rounds)


def test_both_sides_help(spark):
    docs = corpus.documents(spark, [(i, chained(400, i)) for i in range(300)])
    counts, vocab, least, net = model(spark, docs, 6)
    ws = chained(300, 999).split()
    held = corpus.documents(spark, [(0, " ".join(ws)), (1, " ".join(random.Random(1).sample(ws, len(ws))))], 1)
    got = {r["doc_id"]: r["mean_score"] for r in lm.scores(held, net, vocab, lm.rare_shares(counts, vocab, least)).collect()}
    assert got[0] > got[1] + 0.3


def brute_outcome(net, flat, place):
    """ln P of the outcome at a place, by the definition."""
    h = np.tanh(sum(net.w["embed"][flat[place + o]] * net.w["place"][k] for k, o in enumerate(lm.OFFSETS)))
    g, m = divmod(int(flat[place]), lm.MEMBERS)
    outer, inner = net.w["group"] @ h + net.w["group_bias"], net.w["word"][g] @ h + net.w["word_bias"][g]
    return outer[g] - np.log(np.exp(outer).sum()) + inner[m] - np.log(np.exp(inner).sum())


def test_probabilities():
    """Against the definition, and over all outcomes they add up to 1."""
    net = lm.Network.fresh(np.arange(lm.VOCAB, dtype=float))
    flat, at = lm.padded(np.array([5, 7, 900, 4000, 4095, 3, 3], np.int32), np.array([5, 0, 0, 2]))
    assert at.tolist() == [3, 4, 5, 6, 7, 17, 18] and (flat[8:17] == lm.VOCAB).all()
    got = net.log_probabilities(flat, at)
    assert all(abs(got[i] - brute_outcome(net, flat, place)) < 1e-4 for i, place in enumerate(at))
    total = 0.0
    for outcome in range(lm.VOCAB):
        flat[at[2]] = outcome
        total += float(np.exp(net.log_probabilities(flat, at[2:3])[0]))
    assert abs(total - 1) < 1e-4


def test_gradient():
    """Steps lower the loss of what they see; the gradient of a weight is the slope of the loss."""
    net = lm.Network.fresh()
    flat, at = lm.padded(np.random.default_rng(1).integers(0, 400, 500).astype(np.int32), np.array([500]))
    before = net.log_probabilities(flat, at).mean()
    squares = {k: np.full(s, 1e-4, np.float32) for k, s in lm.SHAPES.items()}
    for _ in range(5):
        net.step(flat, at, squares, 0.05)
    assert net.log_probabilities(flat, at).mean() > before + 0.1 and not net.w["embed"][lm.VOCAB].any()
    start = net.vector()
    moved = lm.Network.of(start.copy())
    moved.step(flat, at, squares={k: np.zeros(s, np.float32) for k, s in lm.SHAPES.items()}, rate=1.0)
    signs = np.sign(start - moved.vector())  # with no squares before, a step goes by the gradient's sign
    for i in np.random.default_rng(2).choice(np.flatnonzero(signs), 40, replace=False):
        loss = []
        for d in (-0.02, 0.02):
            v = start.astype(np.float64).copy()
            v[i] += d
            loss.append(-lm.Network.of(v).log_probabilities(flat, at).sum())
        if abs(loss[1] - loss[0]) > 1e-2:
            assert np.sign(loss[1] - loss[0]) == signs[i]


@pytest.mark.parametrize("lexicon", [1 << 18, 200])
def test_whole_query_against_brute_force(spark, monkeypatch, lexicon):
    """Counts, outcomes, shares and sums of a whole table, worked out word by word; with a small lexicon most words are joined."""
    monkeypatch.setattr(lm, "LEXICON", lexicon)
    monkeypatch.setattr(lm, "HELD_WORDS", 50)
    monkeypatch.setattr(lm, "SHARD", 800)
    texts = [*corpus.TEXTS, *[(100 + i, corpus.words(150, i, 9000)) for i in range(40)], (None, corpus.words(90, 3, 9000)), (None, None)]
    docs = corpus.clashing(corpus.documents(spark, texts))
    counts, vocab, least, net = model(spark, docs)
    got = sorted(((str(r["doc_id"]), r["n_tokens"], r["score"], r["mean_score"]) for r in lm.scores(docs, net, vocab, lm.rare_shares(counts, vocab, least)).collect()), key=repr)
    up = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n, name = {}, {}
    for _, t in texts:
        for w, h in zip((t or "").translate(up).split(), hashes(t).tolist(), strict=True):
            n[h], name[h] = n.get(h, 0) + 1, w
    assert len(set(name.values())) == len(name) and {r["word"] % (1 << 64): r["n"] for r in counts.collect()} == n
    ordered = sorted(n, key=lambda h: (-n[h], h))
    known = ordered[: len(vocab.words)]
    assert sorted(known) == vocab.words.tolist() and len(known) <= lexicon and (len(known) == len(n)) == (lexicon > len(n))
    outcome = {h: i if i < min(lm.VOCAB - lm.CLASSES, len(known)) else lm.VOCAB - 1 - h % lm.CLASSES for i, h in enumerate(ordered)}
    size = np.bincount([outcome[h] for h in n], [n[h] for h in n], lm.VOCAB)
    assert np.array_equal(size, vocab.sizes)
    want = []
    for i, t in texts:
        own = hashes(t).tolist()
        flat, at = lm.padded(np.array([outcome[h] for h in own], np.int32), np.array([len(own)]))
        score = sum(brute_outcome(net, flat, p) + np.log(n[h] / size[outcome[h]]) for h, p in zip(own, at, strict=True))
        want.append((str(i), len(own), score, score / len(own) if own else None))
    for a, b in zip(got, sorted(want, key=repr), strict=True):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-3 * (1 + abs(b[2])) and (a[3] is None) == (b[3] is None)


def test_files_do_not_matter(spark, monkeypatch):
    """The same rows in other partitions and another order have the same scores."""
    monkeypatch.setattr(lm, "SHARD", 1500)
    texts = [(i, chained(60, i)) for i in range(120)] + [(None, chained(50, 500)), (None, chained(50, 501)), (7, "twice"), (7, "twice")]
    one = corpus.documents(spark, texts, 1)
    other = corpus.documents(spark, random.Random(4).sample(texts, len(texts)), 7)
    a, b = (sorted(((str(r["doc_id"]), r["n_tokens"], r["score"]) for r in lm.scored(d).collect())) for d in (one, other))
    assert all(x[:2] == y[:2] and abs(x[2] - y[2]) < 1e-3 for x, y in zip(a, b, strict=True))


def test_edges(spark, tmp_path):
    got = lm.query(spark, corpus.written_tables(spark, tmp_path)).collect()
    assert len(got) == len(corpus.TEXTS)
    for r in got:
        n = len((dict(corpus.TEXTS)[r["doc_id"]] or "").encode().split()) if r["doc_id"] != 17 else r["n_tokens"]
        assert r["n_tokens"] == n and (r["mean_score"] is None) == (n == 0) and (n > 0 or r["score"] == 0)
    assert lm.scored(corpus.empty(spark)).count() == 0


def test_every_position_is_a_target_once(spark):
    """Over all rounds, in short texts too."""
    _, at = lm.padded(np.zeros(93, np.int32), np.array([1, 2, 3, 5, 6, 11, 12, 13, 40, 0]))
    for rounds in (1, 2, 5):
        assert sorted(np.concatenate([lm.taken(at, k, rounds, 3) for k in range(rounds)])) == sorted(at)
    docs = corpus.documents(spark, [(i, f"only{i}") for i in range(30)], 1)
    counts, vocab, _, net = model(spark, docs)
    assert (net.w["word_bias"].ravel()[:30] != lm.Network.fresh(vocab.sizes).w["word_bias"].ravel()[:30]).all()


def test_words_seen_twice_score_higher_than_words_seen_once(spark):
    odd = {i: " ".join(f"odd{i}x{j}" for j in range(60)) for i in range(40)}
    texts = [(i, corpus.words(200, i)) for i in range(60)] + [(100 + i, t) for i, t in odd.items()] + [(200 + i, odd[i]) for i in range(0, 40, 2)]
    got = {r["doc_id"]: r["mean_score"] for r in lm.scored(corpus.documents(spark, texts)).select("doc_id", F.col("mean_score")).collect()}
    twice, once = [got[100 + i] for i in range(0, 40, 2)], [got[100 + i] for i in range(1, 40, 2)]
    assert min(twice) > max(once) and min(got[i] for i in range(60)) > max(twice)
