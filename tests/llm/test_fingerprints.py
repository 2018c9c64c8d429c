import hashlib
from collections import Counter

import corpus
import numpy as np

from rivulet.llm import fingerprints


def jaccard(a, b):
    a, b = Counter(a.split()), Counter(b.split())
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_collisions_are_the_generalised_jaccard_similarity():
    draw = fingerprints.Sampler(4096)
    for seed in range(6):
        a = corpus.words(200, seed, 60)
        b = corpus.words(100, seed + 50, 60) + " " + " ".join(a.split()[: 30 * seed])
        got = fingerprints.likeness(draw(fingerprints.terms(a)), draw(fingerprints.terms(b)))
        assert abs(got - jaccard(a, b)) < 0.04


def test_memory_and_chunks_change_nothing():
    small, large = fingerprints.Sampler(32, memory=100), fingerprints.Sampler(32)
    texts = [corpus.words(9000, 1, 20000), corpus.words(50, 2), corpus.words(9000, 3, 20000), corpus.words(50, 2)]
    got = [small(fingerprints.terms(t)) for t in texts]
    assert all((x == large(fingerprints.terms(t))).all() for x, t in zip(got, texts, strict=True)) and (got[1] == got[3]).all()


def test_query(spark, tmp_path):
    texts = [x for x in corpus.TEXTS if x[0] != 17] + [(30, corpus.BASE), (-5, corpus.words(50, 99))]
    got = {r["doc_id"]: r for r in fingerprints.query(spark, corpus.written_tables(spark, tmp_path, texts)).collect()}
    order = sorted(texts, key=lambda x: -x[0])
    draw = fingerprints.Sampler()
    assert len(got) == len(texts)
    for (i, t), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        t, following = t or "", following or ""
        n = len(t)
        edited = t[: n - n // 3] + following[: n // 3]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (n, hashlib.sha256(edited.encode()).hexdigest())
        own, other, nxt = (draw(fingerprints.terms(x)) for x in (t, edited, following))
        assert r["fingerprint"] == fingerprints.printed(own) and r["edited_fingerprint"] == fingerprints.printed(other)
        assert r["near_edited"] == float(np.mean(own == other)) and r["near_next"] == float(np.mean(own == nxt))
    assert got[0]["fingerprint"] == got[1]["fingerprint"] == got[30]["fingerprint"] != got[2]["fingerprint"]
    assert got[4]["fingerprint"] == got[5]["fingerprint"]


def test_ties_nulls_one_row_and_none(spark):
    texts = [(None, "last"), (1, "b"), (1, "a"), (1, "a"), (2, "c")]
    got = fingerprints.compared(corpus.clashing(corpus.documents(spark, texts))).collect()
    assert sorted((r["doc_id"], r["n_chars"]) for r in got if r["doc_id"]) == [(1, 1), (1, 1), (1, 1), (2, 1)] and len(got) == 5
    alone = fingerprints.compared(corpus.documents(spark, [(9, "abc def ghi")])).first()
    assert alone["near_next"] == 1.0 and alone["edited_sha256"] == hashlib.sha256(b"abc def abc").hexdigest()
    assert fingerprints.compared(corpus.empty(spark)).count() == 0
