"""Language-model scores: masked pseudo-likelihood of a bidirectional window network, in numpy.

Every token of a text is predicted, itself masked, from the WINDOW tokens on both sides, and a
document's score is the sum of the logarithms of these conditional probabilities.

* Words: runs without ASCII white space, A-Z in lower case, known by a 64-bit hash. All words of
  all texts are counted. The counts grow with the corpus and stay in the cluster.
* Outcomes: the commonest words have one each, all others share CLASSES of them by hash. A word
  of a class has the probability of the class times its share of the class' tokens in all texts,
  so each word of the corpus has its own. The shares of the LEXICON commonest words are sent to
  all tasks (at most that many rows, whatever the corpus); those of all rarer words are joined.
* Network: context embeddings, weighted by place, are summed and go through tanh; the output is
  a softmax in two levels, a group of outcomes and the outcome within it, whose biases start from
  the counts.
* Training: documents are dealt into logical shards of about SHARD tokens by a hash of their id,
  in an order of their own, so that neither files nor tasks matter. In each round every shard
  starts from the shared weights and trains on its part of the positions, those of all rounds
  being all positions, once each; the shards' weights are averaged by the number of positions,
  in blocks that are summed in the cluster.

Null and empty texts have no tokens, score 0 and a null mean. Repeated rows score alike. Rows
with null doc_id are dealt by their text. An empty table gives no rows. Other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm.common import documents, partitions, written
from rivulet.llm.neardup import text_slices
from rivulet.llm.words import Words, mix

GROUPS, MEMBERS = 64, 64
VOCAB = GROUPS * MEMBERS
CLASSES = 256  # a power of two
LEXICON = 1 << 18
WINDOW, WIDTH = 3, 16
ROUNDS = 2
SHARD, STEP, RATE = 1 << 19, 4096, 0.2
SCORED, HIGHEST = 1 << 13, 80.0
WEIGHTS = 1 << 14
HELD_WORDS = 1 << 20
OFFSETS = [*range(-WINDOW, 0), *range(1, WINDOW + 1)]
SHAPES = {"embed": (VOCAB + 1, WIDTH), "place": (len(OFFSETS), WIDTH), "group": (GROUPS, WIDTH), "group_bias": (GROUPS,), "word": (GROUPS, MEMBERS, WIDTH), "word_bias": (GROUPS, MEMBERS)}
SCORES = "doc_id long, n_tokens long, score double, mean_score double"


def summed(words: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, at = np.unique(words, return_inverse=True)
    return distinct, np.bincount(at, n, len(distinct)).astype(np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts; each task adds up its own words in a table of bounded size before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, size = Words(), [], 0

        def added() -> tuple[np.ndarray, np.ndarray]:
            return summed(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))

        def sent(some: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(some[0]), 1 << 16):
                w, n = (x[at : at + (1 << 16)] for x in some)
                yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n)], names=["word", "n"])

        for batch in batches:
            for _, data, ends in text_slices(batch.column(0)):
                held.append(np.unique(words(data, ends)[0], return_counts=True))
                size += len(held[-1][0])
                if size > HELD_WORDS:
                    some = added()
                    if len(some[0]) > HELD_WORDS // 2:
                        yield from sent(some)
                        held, size = [], 0
                    else:
                        held, size = [some], len(some[0])
        if held:
            yield from sent(added())

    return docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Vocabulary:
    """words: the hashes of the lexicon, ascending; outcome and share (ln, within the outcome) of each; sizes: the tokens of each outcome."""

    words: np.ndarray
    outcome: np.ndarray
    share: np.ndarray
    sizes: np.ndarray

    def __post_init__(self) -> None:
        # where the words of each leading 18 bits begin
        heads = (self.words >> np.uint64(46)).astype(np.int64)
        object.__setattr__(self, "starts", np.searchsorted(heads, np.arange((1 << 18) + 1)).astype(np.int32))
        object.__setattr__(self, "deepest", int(np.diff(self.starts).max()))  # type: ignore[attr-defined]

    def lookup(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Outcomes, ln shares and whether the word is in the lexicon; the share of others is 0 here."""
        head = (words >> np.uint64(46)).astype(np.int64)
        first, end = self.starts.take(head), self.starts.take(head + 1)  # type: ignore[attr-defined]
        found, open_ = np.full(len(words), -1, np.int64), np.flatnonzero(first < end)
        for k in range(self.deepest):  # type: ignore[attr-defined]
            at = first[open_] + k
            hit = self.words.take(at) == words[open_]
            found[open_[hit]] = at[hit]
            open_ = open_[~hit & (at + 1 < end[open_])]
        known = found >= 0
        out = (VOCAB - 1 - (words & np.uint64(CLASSES - 1)).astype(np.int64)).astype(np.int32)
        out[known] = self.outcome.take(found[known])
        share = np.zeros(len(words))
        share[known] = self.share.take(found[known])
        return out, share, known


def rank(n: Column) -> Column:
    """Sixteenths of powers of two: at most 1,009 values."""
    return F.floor(F.log2(n) * 16).cast("int")


def vocabulary(counts: DataFrame) -> tuple[Vocabulary, int]:
    """The lexicon: all words from the least rank on at which there are at most LEXICON of them; and that rank."""
    ranks = sorted(((r["rank"], r["count"]) for r in counts.groupBy(rank(F.col("n")).alias("rank")).count().collect()), reverse=True)
    least, total = 1 << 20, 0
    for r, count in ranks:
        total += count
        if total > LEXICON:
            break
        least = r
    top = counts.where(rank(F.col("n")) >= least).toArrow()  # at most LEXICON rows
    words, n = np.asarray(top.column("word")).astype(np.int64).view(np.uint64), np.asarray(top.column("n")).astype(np.int64)
    order = np.lexsort((words, -n))
    words, n = words[order], n[order]
    own = min(VOCAB - CLASSES, len(words))
    class_of = lambda w: VOCAB - 1 - (w & np.uint64(CLASSES - 1)).astype(np.int64)
    outcome = np.where(np.arange(len(words)) < own, np.arange(len(words)), class_of(words))
    sizes = np.zeros(VOCAB)
    sizes[:own] = n[:own]
    for k, size in counts.groupBy(F.col("word").bitwiseAND(F.lit(CLASSES - 1))).agg(F.sum("n")).collect():
        sizes[VOCAB - 1 - k] += size
    np.subtract.at(sizes, class_of(words[:own]), n[:own])
    share = np.log(n / sizes[outcome]) if len(words) else np.zeros(0)
    order = np.argsort(words)
    return Vocabulary(words[order], outcome[order].astype(np.int32), share[order], sizes), least


def rare_shares(counts: DataFrame, vocab: Vocabulary, least: int) -> DataFrame:
    """(word, share) of the words beyond the lexicon."""
    sizes = F.array(*[F.lit(float(vocab.sizes[VOCAB - 1 - k])) for k in range(CLASSES)])
    size = F.get(sizes, F.col("word").bitwiseAND(F.lit(CLASSES - 1)).cast("int"))
    return counts.where(rank(F.col("n")) < least).select("word", F.log(F.col("n") / size).alias("share"))


def padded(outcomes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The outcomes of several texts with WINDOW of padding (VOCAB) around each, and the places of the tokens there."""
    at = np.arange(len(outcomes)) + WINDOW * (np.repeat(np.arange(len(sizes)), sizes) + 1)
    flat = np.full(len(outcomes) + WINDOW * (len(sizes) + 1), VOCAB, np.int32)
    flat[at] = outcomes
    return flat, at


class Network:
    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def fresh(cls, sizes: np.ndarray | None = None) -> Network:
        """Small random weights; the biases give each outcome its share of all tokens."""
        draw = np.random.default_rng(11)
        w = {k: draw.normal(0, 0.1, s).astype(np.float32) if len(s) > 1 and "bias" not in k else np.zeros(s, np.float32) for k, s in SHAPES.items()}
        w["place"] += 1
        w["embed"][VOCAB] = 0
        if sizes is not None:
            some = sizes.reshape(GROUPS, MEMBERS) + 0.5
            w["group_bias"], w["word_bias"] = np.log(some.sum(axis=1) / some.sum()).astype(np.float32), np.log(some / some.sum(axis=1, keepdims=True)).astype(np.float32)
        return cls(w)

    def hidden(self, flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The hidden layer with a column of ones for the biases, and the outcomes around."""
        around = [flat.take(at + o) for o in OFFSETS]
        total = self.w["embed"].take(around[0], axis=0) * self.w["place"][0]
        for x, place in zip(around[1:], self.w["place"][1:], strict=True):
            total += self.w["embed"].take(x, axis=0) * place
        h = np.ones((len(at), WIDTH + 1), np.float32)
        np.tanh(total, out=h[:, :WIDTH])
        return h, around

    def _heads(self, h: np.ndarray, target: np.ndarray):
        """Scores of the groups, and of the members of the targets' groups; rows must be in order of their targets."""
        inner = np.empty((len(h), MEMBERS), np.float32)
        cuts = np.searchsorted(target, MEMBERS * np.arange(GROUPS + 1)).tolist()
        word = np.concatenate((self.w["word"], self.w["word_bias"][:, :, None]), axis=2).transpose(0, 2, 1)
        for g in range(GROUPS):
            if cuts[g] < cuts[g + 1]:
                np.dot(h[cuts[g] : cuts[g + 1]], word[g], out=inner[cuts[g] : cuts[g + 1]])
        outer = h @ np.concatenate((self.w["group"], self.w["group_bias"][:, None]), axis=1).T
        # exp() of a 32-bit number ends at 88
        return np.minimum(outer, HIGHEST, out=outer), np.minimum(inner, HIGHEST, out=inner), cuts

    def log_probabilities(self, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
        """ln P of the token at each place, given both sides."""
        out, each = np.empty(len(at), np.float64), np.ones(MEMBERS, np.float32)
        for start in range(0, len(at), SCORED):
            part = at[start : start + SCORED]
            order = np.argsort(flat.take(part), kind="stable")
            part = part[order]
            target, rows = flat.take(part), np.arange(len(part))
            outer, inner, _ = self._heads(self.hidden(flat, part)[0], target)
            scores = outer[rows, target // MEMBERS] + inner[rows, target % MEMBERS]
            out[start + order] = scores - np.log((np.exp(outer, out=outer) @ each[:GROUPS]) * (np.exp(inner, out=inner) @ each))
        return out

    def step(self, flat: np.ndarray, at: np.ndarray, squares: dict[str, np.ndarray], rate: float) -> None:
        """One step of Adagrad on the masked places' log loss."""
        at = at[np.argsort(flat.take(at), kind="stable")]
        target, rows = flat.take(at), np.arange(len(at))
        h, around = self.hidden(flat, at)
        outer, inner, cuts = self._heads(h, target)
        for x, own in ((outer, target // MEMBERS), (inner, target % MEMBERS)):
            np.exp(x, out=x)
            x *= (1 / (len(at) * (x @ np.ones(x.shape[1], np.float32))))[:, None]
            x[rows, own] -= 1 / len(at)
        group = outer.T @ h
        word = np.zeros((GROUPS, MEMBERS, WIDTH + 1), np.float32)
        back = outer @ self.w["group"]
        for g in range(GROUPS):
            a, b = cuts[g], cuts[g + 1]
            if a < b:
                np.dot(inner[a:b].T, h[a:b], out=word[g])
                back[a:b] += inner[a:b] @ self.w["word"][g]
        back *= 1 - h[:, :WIDTH] ** 2
        grads = {"group": group[:, :WIDTH], "group_bias": group[:, WIDTH], "word": word[:, :, :WIDTH], "word_bias": word[:, :, WIDTH]}
        one = np.ones(len(at), np.float32)
        grads["place"] = np.stack([one @ (self.w["embed"].take(x, axis=0) * back) for x in around])
        index = np.concatenate(around).astype(np.intp)
        spread = np.concatenate([(back * p).T for p in self.w["place"]], axis=1).astype(np.float64)
        grads["embed"] = np.stack([np.bincount(index, row, VOCAB + 1) for row in spread], 1).astype(np.float32)
        grads["embed"][VOCAB] = 0
        for k, g in grads.items():
            squares[k] += g * g
            self.w[k] -= rate * g / (np.sqrt(squares[k]) + 1e-8)

    def vector(self) -> np.ndarray:
        return np.concatenate([self.w[k].ravel() for k in SHAPES])

    @classmethod
    def of(cls, vector: np.ndarray) -> Network:
        weights, at = {}, 0
        for k, s in SHAPES.items():
            n = int(np.prod(s))
            weights[k] = vector[at : at + n].reshape(s).astype(np.float32)
            at += n
        return cls(weights)


def taken(at: np.ndarray, number: int, rounds: int, seed: int) -> np.ndarray:
    """The places that a round trains on, in an order that mixes them; those of all rounds are all places, once each."""
    order = np.random.Generator(np.random.PCG64(seed)).permutation(len(at))
    return at[order[number::rounds]]


class Shard:
    """The training of one shard in one round."""

    def __init__(self, start: np.ndarray, number: int, rounds: int):
        self.net, self.number, self.rounds = Network.of(start.copy()), number, rounds
        self.squares = {k: np.full(s, 1e-4, np.float32) for k, s in SHAPES.items()}
        self.held: list[np.ndarray] = []
        self.size = self.n = self.blocks = 0

    def add(self, outcomes: np.ndarray) -> None:
        self.held.append(outcomes)
        self.size += len(outcomes)
        if self.size >= 8 * STEP:
            self.learn()

    def learn(self) -> None:
        if self.size:
            flat, at = padded(np.concatenate(self.held), np.array([len(x) for x in self.held]))
            chosen = taken(at, self.number, self.rounds, self.blocks)
            for i in range(0, len(chosen), STEP):
                self.net.step(flat, chosen[i : i + STEP], self.squares, RATE)
            self.n += len(chosen)
        self.held, self.size, self.blocks = [], 0, self.blocks + 1


def train(docs: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS) -> Network:
    """Rounds of training in all shards, and averaging. The driver gets one number for each weight."""
    net = Network.fresh(vocab.sizes)
    shards = max(1, round(float(vocab.sizes.sum()) / SHARD))
    size = len(net.vector())
    n_blocks = -(-size // WEIGHTS)
    n = partitions(docs.sparkSession)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            ids, null = np.asarray(batch.column(0).fill_null(0)), np.asarray(batch.column(0).is_null())
            for first, data, ends in text_slices(batch.column(1)):
                found, stops = words(data, ends)
                outcomes = vocab.lookup(found)[0].astype("<u2")
                own = [x.tobytes() for x in np.split(outcomes, stops[:-1])]
                tie = np.array([xxhash.xxh3_64_intdigest(x) for x in own], np.uint64)
                some = slice(first, first + len(ends))
                shard = np.where(null[some], tie, mix(ids[some].astype(np.int64).view(np.uint64))) % np.uint64(shards)
                yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), batch.column(0)[some], pa.array(tie.view(np.int64)), pa.array(own, pa.binary())], names=["shard", "doc_id", "tie", "outcomes"])

    coded = docs.select("doc_id", "text").mapInArrow(code, "shard int, doc_id long, tie long, outcomes binary")
    dealt = coded.repartition(n, "shard").sortWithinPartitions("shard", "doc_id", "tie").select("shard", "outcomes")

    def blocks_of(vector: np.ndarray, weight: float) -> pa.RecordBatch:
        parts = [vector[i : i + WEIGHTS].tobytes() for i in range(0, size, WEIGHTS)]
        return pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts)), pa.int32()), pa.array(np.full(len(parts), weight)), pa.array(parts, pa.binary())], names=["block", "n", "total"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for block, weight, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                before = sums.get(block, [0.0, 0.0])
                sums[block] = [before[0] + weight, before[1] + np.frombuffer(x.as_buffer(), np.float64)]
        for block, (weight, total) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([weight]), pa.array([total.tobytes()], pa.binary())], names=["block", "n", "total"])

    for number in range(rounds):
        start = net.vector()

        def run(batches: Iterator[pa.RecordBatch], start: np.ndarray = start, number: int = number) -> Iterator[pa.RecordBatch]:
            total, weight, now, own = np.zeros(size), 0.0, None, None

            def closed() -> None:
                nonlocal total, weight
                if own:
                    own.learn()
                    total = total + own.net.vector().astype(np.float64) * own.n
                    weight += own.n

            for batch in batches:
                for shard, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if shard != now:
                        closed()
                        now, own = shard, Shard(start, number, rounds)
                    own.add(np.frombuffer(x.as_buffer(), "<u2"))
            closed()
            if weight:
                yield blocks_of(total, weight)

        kind = "block int, n double, total binary"
        got = dealt.mapInArrow(run, kind).repartition(min(n, n_blocks), "block").mapInArrow(add, kind).collect()
        if not got:
            break
        net = Network.of(np.concatenate([np.frombuffer(r["total"], np.float64) / r["n"] for r in sorted(got, key=lambda r: r["block"])]))
    return net


def scores(docs: DataFrame, net: Network, vocab: Vocabulary, rare: DataFrame) -> DataFrame:
    """doc_id, n_tokens, score (the sum of ln P of all tokens) and its mean. rare: rare_shares()."""
    vector = net.vector()
    names = ["row", "doc_id", "n_tokens", "score", "word", "times"]

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row of each text and one of each of its distinct words beyond the lexicon."""
        own, words = Network.of(vector), Words()
        for batch in batches:
            for first, data, ends in text_slices(batch.column(1)):
                found, stops = words(data, ends)
                sizes = np.diff(stops, prepend=0)
                outcomes, share, known = vocab.lookup(found)
                flat, at = padded(outcomes, sizes)
                owner = np.repeat(np.arange(len(ends)), sizes)
                total = np.bincount(owner, own.log_probabilities(flat, at) + share, len(ends))
                rows = batch.column(2)[first : first + len(ends)]
                # a key of its own for each text, so that no task gets all of them
                alone = pa.array(mix(np.asarray(rows).view(np.uint64)).view(np.int64))
                yield pa.RecordBatch.from_arrays([rows, batch.column(0)[first : first + len(ends)], pa.array(sizes), pa.array(total), alone, pa.nulls(len(ends), pa.int64())], names=names)
                seldom = np.flatnonzero(~known)
                if len(seldom):
                    # equal (text, word) lie together in this order
                    order = seldom[np.lexsort((found[seldom], owner[seldom]))]
                    new = np.ones(len(order), bool)
                    new[1:] = (found[order[1:]] != found[order[:-1]]) | (owner[order[1:]] != owner[order[:-1]])
                    start = np.flatnonzero(new)
                    times, none = np.diff(start, append=len(order)), pa.nulls(len(start), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(np.asarray(rows)[owner[order[start]]]), none, none, none.cast(pa.float64()), pa.array(found[order[start]].view(np.int64)), pa.array(times)], names=names)

    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    held = rows.mapInArrow(parts, "row long, doc_id long, n_tokens long, score double, word long, times long")
    each = held.join(rare.hint("shuffle_hash"), "word", "left").select("row", "doc_id", "n_tokens", F.coalesce("score", F.col("times") * F.col("share"), F.lit(0.0)).alias("score"))
    whole = each.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.sum("score").alias("score"))
    return whole.select("doc_id", "n_tokens", "score", F.when(F.col("n_tokens") > 0, F.col("score") / F.col("n_tokens")).alias("mean_score"))


def scored(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """The scores of docs under a model that is trained on all of them."""
    counts = written(word_counts(docs), "words")
    vocab, least = vocabulary(counts)
    return scores(docs, train(docs, vocab, rounds), vocab, rare_shares(counts, vocab, least))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: the score of every document."""
    return scored(documents(spark, sf_dir))
