import gc
import zlib

import corpus
import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rivulet.llm import packing, tokenfile, tokens

ODD = ["<|startoftext|> a<|ENDOFTEXT|>b <|endoftext|>", "It's DON'T x.y, İ nb\x1csp\x85q ſſ 中文字 漢. ﬁ ½ x² ΑΣ. 'S 'd.", "á,b .,. ,., '", "ǅ ǅxy ªº ʰ", "a\u00a0b\u2003c", "\x00 \ufeff"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokens.tokenizer_path())


def ids(tokenizer, text, end):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_words_give_the_texts_ids(tokenizer):
    code = tokens.WordEncoder(tokens.tokenizer_path(), memory=50)
    pages = [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()]
    assert code.direct
    for text in [*ODD, *(t for _, t in corpus.TEXTS), *pages, *ODD]:
        assert code.encode(text).tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids


def test_codes_round_trip():
    draw = np.random.default_rng(1)
    for counts in ([0], [1], [2, 0, 3], [4, 5, 1000, 0, 7]):
        for top in (1 << 7, 1 << 8, 1 << 16, 1 << 24, 1 << 32):
            n = np.array(counts)
            x = draw.integers(0, top, n.sum(), dtype=np.uint64).astype(np.uint32)
            control, data, control_ends, data_ends = tokenfile.pack(x, n)
            assert (tokenfile.unpack(control, data, n) == x).all()
            assert control_ends[-1] == len(control) == sum(-(-k // 4) for k in counts) and data_ends[-1] == len(data)
    control, data, *_ = tokenfile.pack(np.array([5, 300, 70000, 1 << 30], np.uint32), np.array([4]))
    assert control.tobytes() == bytes([0b11100100]) and len(data) == 1 + 2 + 3 + 4


def test_token_files(spark, tmp_path, tokenizer):
    texts = [x for x in corpus.TEXTS if x[0] != 17] + [(50 + i, t) for i, t in enumerate(ODD)] + [(-3, "first")]
    got = sorted(tuple(r) for r in tokenfile.query(spark, corpus.written_tables(spark, tmp_path, texts)).collect())
    at = 0
    for r, (i, t) in zip(got, sorted(texts, key=lambda x: x[0]), strict=True):
        x = ids(tokenizer, t, 2)
        assert r == (i, at, len(x), zlib.crc32(x.tobytes()))
        at += len(x)


def test_token_files_of_repeated_and_null_ids(spark, tmp_path, tokenizer):
    texts = [(1, "b"), (1, "a a"), (1, "a a"), (None, None), (None, "z"), (0, "q")]
    tokenfile.write(corpus.clashing(corpus.documents(spark, texts)), str(tmp_path / "f"))
    got = tokenfile.read(spark, str(tmp_path / "f")).collect()
    assert sorted(bytes(r["ids"]) for r in got) == sorted(ids(tokenizer, t, 2).tobytes() for _, t in texts)
    starts = sorted((r["start"], r["n_tokens"]) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(starts[:-1], starts[1:], strict=True)) and starts[0][0] == 0


def test_commonest_ids_take_one_byte(spark, tmp_path):
    tokenfile.write(corpus.documents(spark, [(1, "zebra " * 500 + "quick")]), str(tmp_path / "f"))
    r = spark.read.parquet(str(tmp_path / "f/tokens")).first()
    assert len(r["data"]) == r["n_tokens"] and len(r["control"]) == -(-r["n_tokens"] // 4)


def test_no_rows(spark, tmp_path):
    tokenfile.write(corpus.empty(spark), str(tmp_path / "f"))
    assert tokenfile.read(spark, str(tmp_path / "f")).count() == 0
    from rivulet.llm.common import written

    assert packing.pack(written(packing.pieces(corpus.empty(spark)), "pieces")).count() == 0


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing(spark, tmp_path, tokenizer):
    texts = corpus.TEXTS + [(100 + i, corpus.words(1 + i * 13 % 700, i)) for i in range(150)]
    got = packing.query(spark, corpus.written_tables(spark, tmp_path, texts)).collect()
    want = []
    for i, t in texts:
        x = ids(tokenizer, t, 1)
        want += [(i, k, at, len(x[at : at + 4096]), zlib.crc32(x[at : at + 4096].tobytes())) for k, at in enumerate(range(0, len(x), 4096))]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    n = check_packing(got, 4096)
    assert n <= -(-sum(x[3] for x in want) // 4096) + 1


def test_fullest_is_the_best_subset():
    import itertools
    import random

    draw = random.Random(2)
    for _ in range(60):
        lengths = [draw.randrange(1, 30) for _ in range(draw.randrange(1, 9))]
        counts = {x: lengths.count(x) for x in lengths}
        seed, capacity = max(lengths), 40
        rest = list(lengths)
        rest.remove(seed)
        best = max(seed + sum(c) for n in range(len(rest) + 1) for c in itertools.combinations(rest, n) if seed + sum(c) <= capacity)
        used = packing.fullest(counts, seed, capacity)
        assert sum(k * n for k, n in used.items()) == best and all(n <= counts[k] for k, n in used.items())


def test_plan_uses_every_piece_once():
    counts = {7: 1000, 3: 501, 5: 1, 10: 33, 1: 2}
    rows = packing.plan(counts, 10)
    for length, n in counts.items():
        spans = sorted((r[1], r[1] + r[2] * r[4]) for r in rows if r[0] == length)
        assert spans[0][0] == 0 and spans[-1][1] == n and all(a[1] == b[0] for a, b in zip(spans[:-1], spans[1:], strict=True))
    assert max(r[3] + r[4] for r in rows) <= 1036 and len(rows) < 40


def test_packing_leaves_no_memory_of_many_words_in_idle_workers(spark):
    def held(batches):
        list(batches)
        yield pa.RecordBatch.from_arrays([pa.array([sum(len(m.row) for x in gc.get_objects() if isinstance(x, tokens.WordEncoder) for m in (x.held, x.old))], pa.int64())], names=["n"])

    n = tokens.KEPT + 5000
    texts = [" ".join(f"w{i}x{k}" for k in range(n)) for i in range(2)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2, "doc_id")
    assert packing.pieces(docs).agg(F.sum("length"), F.countDistinct("doc_id")).first()[1] == 2
    assert max(r[0] for r in spark.range(8).repartition(8).mapInArrow(held, "n long").collect()) <= tokens.KEPT
