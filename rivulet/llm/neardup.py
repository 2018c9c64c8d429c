"""N-gram Jaccard join: documents whose sets of word shingles are alike, and the classes that such links make.

1. Every whole text becomes the sorted set of its shingles' 64-bit hashes, by array operations
   over whole batches. Documents with equal sets are one set from here on, so copies cost nothing.
2. Shingles are ordered by how common they are, rare ones first, then by hash. Two sets that
   share enough share one of their first ones, whatever the order (n less the overlap that a
   link needs, plus one); with rare ones first, passages that many documents share don't bring
   their documents together. The counts that tell the order come from all documents, in a table
   of 2^20 buckets; their accuracy changes the cost alone.
3. A tile is one of these first shingles and a size band. A set belongs to the tiles of its own
   band and of the next one, as sizes of a link lie in the same or the next band. Within a tile,
   the places of the shared shingle in both orders bound the overlap, and then the sets' bitmaps
   do: each bit that one set has and the other lacks is at least one element that they don't
   share. Only pairs that the bounds let through have their sorted arrays intersected, which
   decides.
4. Links that join nothing new are not looked for. The first round holds each set against one
   member of its tiles; the last takes all pairs of all tiles whose two sets are in different
   classes still. So a large group of near copies costs a few pairs for each member and not all
   pairs, and no link between different classes is lost.
5. No task takes a whole large tile. In the first round its members are dealt over parts, in the
   last its largest class and all others are cut into blocks of about BLOCK members, and each
   pair of blocks is a unit of work of its own.

Texts without words (null, empty) have no shingles and are linked with nothing. Texts with fewer
words than a shingle have one, their whole sequence. Rows with equal doc_id share a class; rows
with null doc_id are in none (component_id null). An empty table gives no rows; other columns
are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rivulet.llm.common import discard, documents, free, partitions, small_batches, written
from rivulet.llm.tokens import forget
from rivulet.llm.words import Words, mix

BUCKET_BITS, COUNTS = 20, 1 << 14
CENTRES, BEST, PART, BLOCK = 32, 4, 4096, 512
FILTER_BITS = 23
LEAST_WORDS, MOST_WORDS = 16, 1024
SLICE = 1 << 19
PAIRS = 1 << 18
SIGNATURE = "doc_id long, n int, h1 long, h2 long, first array<long>, bits binary"

_draw = np.random.Generator(np.random.PCG64(20240607))
#: Two random odd numbers for each place in a shingle.
PLACE = _draw.integers(0, 1 << 63, (2, 64), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Shingler:
    """Hashes of all k-word shingles of some texts at once, from the hashes of their words."""

    def __init__(self, k: int):
        self.k, self.words = k, Words()

    def __call__(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """data: the texts' bytes, one after another; ends: where each ends. The hashes, and where each text's end."""
        words, last_word = self.words(data, ends)
        n_words = np.diff(last_word, prepend=0)
        k, m = self.k, len(words)
        grams = np.zeros(max(m - k + 1, 0), np.uint64)
        if m >= k:
            for j in range(k):
                grams += mix(words[j : m - k + 1 + j] + PLACE[0, j]) * PLACE[1, j]
            grams = mix(grams)
        long = n_words >= k
        n_grams = np.where(long, n_words - k + 1, (n_words > 0).astype(np.int64))
        first = last_word - n_words
        out_ends = np.cumsum(n_grams)
        out = np.zeros(int(out_ends[-1]) if len(out_ends) else 0, np.uint64)
        counts = n_grams[long]
        if len(counts):
            within = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
            out[np.repeat((out_ends - n_grams)[long], counts) + within] = grams[np.repeat(first[long], counts) + within]
        for i in np.flatnonzero((n_words > 0) & ~long):  # shorter than a shingle: the whole sequence
            out[out_ends[i] - 1] = xxhash.xxh3_64_intdigest(words[first[i] : last_word[i]].tobytes())
        return out, out_ends


def text_slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """A text column in slices of about SLICE bytes (at least a text): first row, bytes, ends of texts. Nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, side="right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at + 1 : to + 1] - offsets[at]
        at = to


def gram_sets(column: pa.Array, shingler: Shingler) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of each text."""
    for _, data, ends in text_slices(column):
        grams, stops = shingler(data, ends)
        for a, b in zip(np.concatenate(([0], stops[:-1])), stops, strict=True):
            yield np.unique(grams[a:b])


def commonness(docs: DataFrame, k: int) -> np.ndarray:
    """How common the shingles of each bucket of hashes are, 0 to 255: in proportion to the count up to four times the mean, then logarithmic.

    Each task sends counts in blocks, which are summed in the cluster; the driver gets one
    number for each bucket, however many documents there are.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()  # what an earlier stage's tokens left in this worker
        counts, shingler, held, n = np.zeros(1 << BUCKET_BITS, np.int64), Shingler(k), [], 0

        def counted() -> None:
            nonlocal n
            if held:
                counts[:] += np.bincount(np.concatenate(held), minlength=1 << BUCKET_BITS)
            held.clear()
            n = 0

        for batch in batches:
            for _, data, ends in text_slices(batch.column(0)):
                grams, _ = shingler(data, ends)
                held.append((grams >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
                n += len(grams)
                if n >= 1 << BUCKET_BITS:
                    counted()
        counted()
        blocks = np.minimum(counts, 65535).astype("<u2").reshape(-1, COUNTS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(blocks)), pa.int32()), pa.array([b.tobytes() for b in blocks], pa.binary())], names=["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[block] = sums.get(block, 0) + np.frombuffer(x.as_buffer(), "<u2").astype("<u4")
        yield pa.RecordBatch.from_arrays([pa.array([*sums], pa.int32()), pa.array([b.tobytes() for b in sums.values()], pa.binary())], names=["block", "counts"])

    kind = "block int, counts binary"
    n = min(partitions(docs.sparkSession), (1 << BUCKET_BITS) // COUNTS)
    summed = docs.select("text").mapInArrow(count, kind).repartition(n, "block").mapInArrow(add, kind)
    blocks = {block: np.frombuffer(x, "<u4") for block, x in summed.collect()}
    usual = max(sum(int(x.sum()) for x in blocks.values()) / (1 << BUCKET_BITS), 1.0)
    out = np.zeros(((1 << BUCKET_BITS) // COUNTS, COUNTS), np.uint8)
    for block, x in blocks.items():
        high = 192 + 4 * np.log2(np.maximum(x / (4 * usual), 1))
        out[block] = np.where(x < 4 * usual, 48 * x / usual, np.minimum(high, 255))
    return out.ravel()


def needed(n: int, percent: int) -> int:
    """The least overlap of a set of n with any that it is linked to."""
    return -(-percent * n // 100)


def bitmap(s: np.ndarray) -> np.ndarray:
    """The words of a set's bitmap: a power of two of them, about two bits for each member. Half as many are the two halves laid over each other."""
    words = min(max(LEAST_WORDS, 1 << max(2 * len(s) // 64, 1).bit_length() - 1), MOST_WORDS)
    marks = np.zeros(64 * words, bool)
    marks[(s >> np.uint64(20)) & np.uint64(64 * words - 1)] = True
    return np.packbits(marks).view(np.uint64)


def signatures(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The size, a 128-bit hash, the first shingles in order and the bitmap of each document's set, written."""
    common = docs.sparkSession.sparkContext.broadcast(commonness(docs, k).tobytes())  # 2^20 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, shingler = np.frombuffer(common.value, np.uint8), Shingler(k)
        names = [x.split()[0] for x in SIGNATURE.split(", ")]
        for batch in batches:
            sizes, hashes, first, bits = [], [], [], []
            for s in gram_sets(batch.column(1), shingler):
                n = len(s)
                h = xxhash.xxh3_128_intdigest(s.tobytes())
                sizes.append(n)
                hashes.append((h >> 64, h & (1 << 64) - 1))
                bits.append(bitmap(s).tobytes())
                prefix = n - needed(n, percent) + 1 if n else 0
                rank = classes[(s >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
                order = np.argsort(rank, kind="stable")[:prefix]
                first.append(s[order].view(np.int64))
            halves = np.array(hashes, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(first, pa.list_(pa.int64())), pa.array(bits, pa.binary())], names=names)

    out = written(docs.select("doc_id", "text").mapInArrow(run, SIGNATURE), "signatures")
    common.unpersist()
    return out


def among(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose v is wanted and, beyond some ten millions of them, more and more others: a bitmap of 2^FILTER_BITS hashes of the wanted ones lets them through where they lie."""
    place = F.pmod(F.xxhash64("v"), F.lit(1 << FILTER_BITS))
    # Spark's bitmaps count blocks of 2^15 bits, and places, from 1
    marks = wanted.select((place + 1).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    table = np.zeros((1 << (FILTER_BITS - 15), 4096), np.uint8)
    for block, bits in marks.collect():
        table[block - 1] = np.frombuffer(bits, np.uint8)
    held = table.tobytes()  # 2^20 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.frombuffer(held, np.uint8)
        for batch in batches:
            at = np.asarray(batch.column(batch.num_columns - 1))
            yield batch.filter(pa.array((seen[at >> 3] >> (at & 7) & 1).astype(bool))).select([*range(batch.num_columns - 1)])

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.withColumn("__place", place).mapInArrow(run, kind)


def gram_arrays(texts: DataFrame, k: int) -> DataFrame:
    """v and the bytes of the sorted array of its shingle hashes; texts without any are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(k)
        for batch in batches:
            sets = [s.tobytes() for s in gram_sets(batch.column(1), shingler)]
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["v", "grams"])
            yield out.filter(pa.array([len(s) > 0 for s in sets], pa.bool_()))

    return texts.select("v", "text").mapInArrow(run, "v long, grams binary")


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """How many members two sorted arrays without repeats share: the shorter one's are sought in the longer."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int(np.count_nonzero(y[at] == x))


def linked(pairs: DataFrame, arrays: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sorted arrays intersect in enough members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = overlap(s, t)
                ok.append(100 * common >= percent * (len(s) + len(t) - common))
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    side = lambda v, x: arrays.select(F.col("v").alias(v), F.col("grams").alias(x)).hint("merge")
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def labelled(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct vertices of some edges and the least vertex of the component that each is in."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        low = np.minimum(x, y)
        if np.array_equal(x, y):
            return nodes, nodes[label]
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while not np.array_equal(label, hop := label[label]):
            label = hop


def components(edges: DataFrame) -> DataFrame:
    """(v, component) for each end of an edge: the least vertex of its component.

    Each vertex u keeps edges to lesser ones. In a round, the edges are dealt out by u, each task
    finds the components of its part and leaves every vertex one edge, to the least of its
    component there; vertices that belong to other parts take theirs on to the next round. When
    none do, each vertex has one parent, and parents are followed, doubling the way each time.
    Each round is one exchange and is written; only counts reach the driver.
    """
    spark = edges.sparkSession
    n = partitions(spark)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(np.asarray(b.column(0)), np.asarray(b.column(1))) for b in batches]
        if not parts:
            return
        u, v = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        nodes, root = labelled(u, v)
        keep = nodes != root
        own = np.isin(nodes[keep], u)
        yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(root[keep]), pa.array(~own)], names=["u", "v", "away"])

    state = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    stored: DataFrame | None = None

    def kept(df: DataFrame) -> DataFrame:
        """df, written; what it was made from is deleted."""
        nonlocal stored
        out = written(df, "edges")
        if stored is not None:
            discard(stored)
        stored = out
        return out

    while True:
        seen = Observation()
        out = state.repartition(n, "u").mapInArrow(merged, "u long, v long, away boolean")
        state = kept(out.observe(seen, F.count_if("away").alias("away")).drop("away"))
        if not seen.get["away"]:
            break
    while True:
        step = written(state.select(F.col("v").alias("p")).distinct().join(state.select(F.col("u").alias("p"), F.col("v").alias("up")), "p"), "parents")
        if step.isEmpty():
            discard(step)
            return state.select(F.col("u").alias("v"), F.col("v").alias("component")).unionByName(state.select("v", F.col("v").alias("component")).distinct())
        state = kept(state.join(step, state["v"] == step["p"], "left").select("u", F.coalesce("up", "v").alias("v")))
        discard(step)


def band(percent: int) -> Column:
    return F.floor(F.log("n") / (1.0001 * math.log(100 / percent))).cast("int")


class Bitmaps:
    """A column of bitmaps of several widths."""

    def __init__(self, column: pa.Array | pa.ChunkedArray):
        each = column.to_pylist()
        self.width = np.array([len(x) // 8 for x in each], np.int64)
        self.start = np.cumsum(self.width) - self.width
        self.flat = np.frombuffer(b"".join(each), np.uint64)

    def at(self, rows: np.ndarray, width: int) -> np.ndarray:
        """The rows' bitmaps, laid over themselves down to a width."""
        out = np.empty((len(rows), width), np.uint64)
        own = self.width[rows]
        for w in np.unique(own).tolist():
            some = np.flatnonzero(own == w)
            words = self.flat[self.start[rows[some]][:, None] + np.arange(w)]
            out[some] = np.bitwise_or.reduce(words.reshape(len(some), w // width, width), axis=1)
        return out

    def most(self, i: np.ndarray, other: Bitmaps, j: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        """A bound from above of the overlaps of sets of n and m: the bits that both have, and the members that share a bit with another of their set."""
        out = np.empty(len(i), np.int64)
        narrow = np.minimum(self.width[i], other.width[j])
        for w in np.unique(narrow).tolist():
            for some in np.array_split(np.flatnonzero(narrow == w), max(1, len(i) * w >> 22)):
                x, y = self.at(i[some], w), other.at(j[some], w)
                ones = lambda b: np.bitwise_count(b).sum(axis=1, dtype=np.int64)
                out[some] = ones(x & y) + np.minimum(n[some] - ones(x), m[some] - ones(y))
        return out


def numbers(table: pa.Table, but: tuple[str, ...] = ()) -> dict[str, np.ndarray]:
    return {c: table.column(c).to_numpy() for c in table.column_names if c not in but}


def likeliest(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), for each a the BEST ones by the bound that their bitmaps give, of those that it lets through; in order of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, every = numbers(pa.Table.from_batches([batch]), ("x", "y")), np.arange(batch.num_rows)
            n, m = g["n"].astype(np.int64), g["m"].astype(np.int64)
            most = Bitmaps(batch.column("x")).most(every, Bitmaps(batch.column("y")), every, n, m)
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(most / np.maximum(n + m, 1))], names=["a", "b", "share"])
            yield out.filter(pa.array((100 + percent) * most >= percent * (n + m)))

    side = lambda v, n, bits: sets.select(F.col("v").alias(v), F.col("n").alias(n), F.col("bits").alias(bits)).hint("shuffle_hash")
    both = pairs.join(side("b", "m", "y"), "b").join(side("a", "n", "x"), "a")
    judged = both.select("a", "b", "n", "m", "x", "y").mapInArrow(run, "a long, b long, share double")
    best = judged.withColumn("place", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("share"), "b"))).where(F.col("place") <= BEST)
    return best.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def in_units(keys: list[str], made):
    """What mapInArrow runs on rows in order of their unit's keys: made(table) on whole units, several at once; a unit may lie in many batches."""

    def start_of_last(batch: pa.RecordBatch) -> int:
        same = np.ones(batch.num_rows, bool)
        for c in keys:
            x = batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
            same &= x == x[-1]
        return int(np.argmax(same))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the unit that the batch before ended in
        for batch in batches:
            if not batch.num_rows:
                continue
            if cut := start_of_last(batch):
                yield from made(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from made(pa.Table.from_batches(held))

    return run


def starts(g: dict[str, np.ndarray], keys: list[str]) -> np.ndarray:
    """Which rows begin a unit."""
    new = np.zeros(len(g[keys[0]]), bool)
    new[0] = True
    for c in keys:
        new[1:] |= g[c][1:] != g[c][:-1]
    return new


def of_sizes(g: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Pairs of different sets whose sizes allow a link, at least one of them of the tile's own band: the band below has a tile for itself."""
    n, m = g["n"][i].astype(np.int64), g["n"][j].astype(np.int64)
    return (g["v"][i] != g["v"][j]) & ~(g["below"][i] & g["below"][j]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))


def distinct_rows(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    found = np.unique(np.stack((a, b), 1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])


def banded(rows: DataFrame, percent: int) -> DataFrame:
    """Each row in its own size band and, as one from below, in the next."""
    both = F.array(F.struct(F.lit(0).alias("up"), F.lit(False).alias("below")), F.struct(F.lit(1).alias("up"), F.lit(True).alias("below")))
    out = rows.withColumn("__at", F.explode(both))
    return out.withColumns({"band": band(percent) + F.col("__at.up"), "below": F.col("__at.below")}).drop("__at")


def star_pairs(tiles: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Each set with the BEST ones, by their bitmaps, of the centres of its tiles, where sizes and bitmaps allow a link.

    A tile's centre is its least member by one of CENTRES hashes, which the tile's shingle
    chooses, so that near copies meet the same few centres in all of their tiles. Tiles of more
    than PART members are dealt over parts that each have their own.
    """
    keys = ["key", "band", "part"]

    def made(table: pa.Table) -> Iterator[pa.RecordBatch]:
        g = numbers(table)
        new = starts(g, keys)
        start = np.flatnonzero(new)
        i, j = np.flatnonzero(~new), np.repeat(start, np.diff(start, append=len(new)))[~new]
        ok = of_sizes(g, i, j, percent)
        yield distinct_rows(g["v"][i[ok]], g["v"][j[ok]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, unit = None, None  # the first row of the unit that the batch before ended in: all that later rows need
        for batch in batches:
            if batch.num_rows:
                g = numbers(pa.Table.from_batches([batch]))
                yield from made(pa.Table.from_batches([first, batch] if unit == tuple(g[c][0] for c in keys) else [batch]))
                if unit != (last := tuple(g[c][-1] for c in keys)):
                    first, unit = batch.slice(int(np.flatnonzero(starts(g, keys))[-1]), 1), last

    part = F.pmod(F.xxhash64("v", "key"), F.ceil(F.col("members") / PART)).cast("int")
    by = F.xxhash64("v", F.pmod("key", F.lit(CENTRES)))
    rows = banded(tiles.select("key", "v", "n", part.alias("part")), percent)
    dealt = rows.repartition(partitions(tiles.sparkSession), *keys).sortWithinPartitions(*keys, by, "v")
    pairs = dealt.select(*keys, "v", "n", "below").mapInArrow(run, "a long, b long").distinct()
    return likeliest(pairs, sets, percent)


def pairs_apart(tiles: DataFrame, sets: DataFrame, known: DataFrame | None, percent: int) -> DataFrame:
    """All pairs of all tiles whose classes differ and whose bounds allow a link. known: (v, component); None: each set is a class.

    A tile's largest class and its other members are cut into blocks; a unit is a block of the
    class with a block of the others, or two blocks of the others.
    """
    own = tiles.withColumn("c", F.col("v")) if known is None else tiles.join(known.hint("shuffle_hash"), "v", "left").withColumn("c", F.coalesce("component", "v")).drop("component")
    own = written(banded(own.drop("members"), percent), "open")
    count = own.groupBy("key", "band", "c").agg(F.count("*").alias("of_c"), F.max(~F.col("below")).alias("here"))
    sizes = count.groupBy("key", "band").agg(F.max(F.struct("of_c", "c")).alias("most"), F.sum("of_c").alias("members"), F.count("*").alias("kinds"), F.max("here").alias("here")).where("kinds > 1 and here")
    rows = own.join(sizes.drop("here").hint("shuffle_hash"), ["key", "band"]).join(sets.select("v", "n", "bits").hint("shuffle_hash"), ["v", "n"])

    others = F.col("members") - F.col("most.of_c")
    blocks = lambda m: F.ceil(m / BLOCK).cast("int")
    large, small = blocks(F.col("most.of_c")), blocks(others)
    mine = lambda n: F.pmod(F.xxhash64("v", "n", "bits"), n).cast("int")
    unit = lambda kind, i, j, side, within: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.alias("side"), within.alias("within"))
    zero, yes, no = F.lit(0), F.lit(True), F.lit(False)
    each = lambda n, f: F.transform(F.sequence(zero, n - 1), f)
    in_class = each(small, lambda o: unit(0, mine(large), o, zero, no))
    across = each(large, lambda d: unit(0, d, mine(small), F.lit(1), no))
    inside = each(small, lambda o: unit(1, F.least(o, mine(small)), F.greatest(o, mine(small)), (o < mine(small)).cast("int"), o == mine(small)))
    whole = F.array(unit(2, zero, zero, zero, yes))
    units = F.when(F.col("members") <= BLOCK, whole).when(F.col("c") == F.col("most.c"), in_class).when(F.col("kinds") > 2, F.concat(across, inside)).otherwise(across)
    keys = ["key", "band", "kind", "i", "j"]

    def all_pairs(after: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Each row with each of the `after` next ones, about PAIRS at once."""
        sums = np.concatenate(([0], np.cumsum(after)))
        at = 0
        while at < len(after):
            to = max(at + 1, int(np.searchsorted(sums, sums[at] + PAIRS, side="right")) - 1)
            i = np.repeat(np.arange(at, to), after[at:to])
            yield i, i + 1 + np.arange(len(i)) - np.repeat(sums[at:to] - sums[at], after[at:to])
            at = to

    def made(table: pa.Table) -> Iterator[pa.RecordBatch]:
        g, bits = numbers(table, ("bits",)), Bitmaps(table.column("bits"))
        start = np.flatnonzero(starts(g, keys))
        size = np.diff(start, append=table.num_rows)
        for i, j in all_pairs(np.repeat(start + size, size) - np.arange(table.num_rows) - 1):
            ok = (g["c"][i] != g["c"][j]) & (g["within"][i] | (g["side"][i] != g["side"][j]))
            i, j = i[ok], j[ok]
            ok = of_sizes(g, i, j, percent)
            i, j = i[ok], j[ok]
            n, m = g["n"][i].astype(np.int64), g["n"][j].astype(np.int64)
            # if this shingle is the first that both have, they share no more than what follows it; at an earlier one they are a pair already
            rest = 1 + np.minimum(n - g["pos"][i] - 1, m - g["pos"][j] - 1)
            ok = (100 + percent) * rest >= percent * (n + m)
            i, j, n, m = i[ok], j[ok], n[ok], m[ok]
            ok = (100 + percent) * bits.most(i, bits, j, n, m) >= percent * (n + m)
            x, y = g["v"][i[ok]], g["v"][j[ok]]
            yield distinct_rows(np.maximum(x, y), np.minimum(x, y))

    cut = rows.withColumn("__unit", F.explode(units)).select("key", "band", "__unit.*", "v", "n", "pos", "below", "bits", "c")
    dealt = cut.repartition(partitions(tiles.sparkSession), *keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(in_units(keys, made), "a long, b long").distinct()


class Join:
    """What both rounds of a join share: the documents' signatures, the distinct sets and their tiles, all written."""

    def __init__(self, docs: DataFrame, k: int, percent: int):
        self.k, self.percent = k, percent
        self.signed = signatures(docs, k, percent)
        usable = self.signed.where("n > 0 and doc_id is not null")
        one = [F.first(c).alias(c) for c in ("n", "first", "bits")]
        self.sets = written(usable.groupBy("h1", "h2").agg(F.min("doc_id").alias("v"), *one), "sets")
        rows = self.sets.select("v", "n", F.posexplode("first").alias("pos", "key"))
        busy = rows.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
        self.tiles = written(rows.join(busy.hint("shuffle_hash"), "key").select("key", "pos", "v", "n", "members"), "tiles")
        self.texts = docs.select(F.col("doc_id").alias("v"), "text").where("v is not null")

    def links(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs that are linked, written."""
        likely = written(pairs, "likely")
        arrays = written(gram_arrays(among(self.texts, likely.select(F.explode(F.array("a", "b")).alias("v"))), self.k), "arrays")
        out = written(linked(likely, arrays, self.percent), "links")
        discard(likely, arrays)
        return out


def links(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(a, b): all links between different sets, each set under the smallest doc_id that has it. There are as many rows as links, so a large group of near copies gives very many."""
    with small_batches(docs.sparkSession):
        join = Join(docs, k, percent)
        return join.links(pairs_apart(join.tiles, join.sets, None, percent)).distinct()


def classes(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id that links of `percent` or more lead to."""
    with small_batches(docs.sparkSession):
        join = Join(docs, k, percent)
        near = join.links(star_pairs(join.tiles, join.sets, percent))
        far = join.links(pairs_apart(join.tiles, join.sets, components(near), percent))
        final = components(near.unionByName(far))
        discard(join.tiles, near, far)
    by_set = join.sets.select("h1", "h2", "v").join(final.hint("shuffle_hash"), "v", "left").select("h1", "h2", F.coalesce("component", "v").alias("c"))
    own = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("c", "doc_id"))
    found = join.signed.select("doc_id", "n", "h1", "h2").join(by_set.hint("shuffle_hash"), ["h1", "h2"], "left")
    return found.select("doc_id", F.col("n").cast("long").alias("n_shingles"), own.alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs' rows, one of each class: that of the smallest doc_id.

    Repeated rows (equal doc_id, equal words) stay once; rows that share a doc_id alone all stay
    or go with their class. Rows with null doc_id are judged under an id above all others, made
    of their text, so that of a class another row stays, if there is one.
    """
    own, seen, high = free("__id", docs.columns), free("__seen", docs.columns), F.lit(1 << 62)
    made = F.coalesce("doc_id", high + F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), high))
    ids = docs.select(made.alias("doc_id"), "text")
    gone = written(classes(ids, k, percent).where("component_id <> doc_id").select(F.col("doc_id").alias(own)).distinct(), "gone")
    again = written(ids.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select(F.col("doc_id").alias(own)), "again")
    rows = docs.withColumn(own, made)
    if again.isEmpty():
        return rows.join(gone, own, "left_anti").select(*docs.columns)
    rest = rows.join(gone.unionByName(again).distinct(), own, "left_anti")
    repeated = rows.join(again, own, "left_semi").join(gone, own, "left_anti")
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    once = repeated.withColumn(seen, F.xxhash64(F.array_join(words, " "))).dropDuplicates([own, seen])
    return rest.select(*docs.columns).unionByName(once.select(*docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: classes of documents that share 85 percent of their four-word shingles."""
    return classes(documents(spark, sf_dir), 4, 85)


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE
        list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')) END) AS grams FROM d),
n AS (SELECT doc_id, len(grams) AS n FROM s),
g AS (SELECT doc_id, unnest(grams) AS gram FROM s),
f AS (SELECT gram, count(*) AS df FROM g GROUP BY 1),
o AS (SELECT g.doc_id, g.gram, row_number() OVER (PARTITION BY g.doc_id ORDER BY f.df, g.gram) AS pos FROM g JOIN f USING (gram)),
p AS (SELECT o.doc_id, o.gram, n.n FROM o JOIN n USING (doc_id) WHERE o.pos <= n.n - (85 * n.n + 99) // 100 + 1),
c AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b, x.n AS m, y.n AS n FROM p x JOIN p y ON x.gram = y.gram AND x.doc_id < y.doc_id WHERE 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n)),
l AS (SELECT a, b FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 185 * len(list_intersect(x.grams, y.grams)) >= 85 * (m + n)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, min(r.b) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY 1, 2
"""
