"""Sharding over fixed virtual slots (DataFrame operations only).

Records hash into thousands of virtual slots. The bytes of each slot are aggregated, and a
slot-to-shard map, which has a row for each slot and so a fixed size, is stored by version:
version 0 deals the slots in turn, each later version is the one before it with slots moved
from the fullest shard to the emptiest until no move makes the sizes more even.

Null doc_id hashes like any value, null text has no bytes, repeated rows share a slot, an
empty table gives an empty result and the version 0 map; extra columns are not looked at.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rivulet.llm.common import documents, shared_path

N_SLOTS = 8192
MAP_SCHEMA = "version int, vslot int, shard int, first_place long, bytes long, n_rows long"


def virtual_slot(key: Column, n_slots: int = N_SLOTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_slots)).cast("int")


def record_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def rebalanced(shard_of: list[int], sizes: list[int], n_shards: int) -> list[int]:
    """An edited copy of the map. Each edit moves the slot that halves the gap best; sums of squares fall, so it ends."""
    shard_of, loads = list(shard_of), [0] * n_shards
    held: list[list[tuple[int, int]]] = [[] for _ in range(n_shards)]
    for slot, shard in enumerate(shard_of):
        if sizes[slot]:
            loads[shard] += sizes[slot]
            insort(held[shard], (sizes[slot], slot))
    while True:
        order = sorted(range(n_shards), key=lambda s: (loads[s], s))
        low = order[0]
        for high in reversed(order):
            gap = loads[high] - loads[low]
            at = bisect_left(held[high], (gap / 2, -1))
            near = [held[high][i] for i in (at - 1, at) if 0 <= i < len(held[high])]
            best = min(near, key=lambda x: (abs(gap - 2 * x[0]), x), default=(gap, -1))
            if 0 < best[0] < gap:
                break
        else:
            return shard_of
        held[high].remove(best)
        insort(held[low], best)
        loads[high] -= best[0]
        loads[low] += best[0]
        shard_of[best[1]] = low


def map_rows(version: int, shard_of: list[int], sizes: list[int], counts: list[int], n_shards: int) -> list[tuple]:
    """The map's rows; first_place: the rows that the earlier slots of its shard hold."""
    at, rows = [0] * n_shards, []
    for slot, shard in enumerate(shard_of):
        rows.append((version, slot, shard, at[shard], sizes[slot], counts[slot]))
        at[shard] += counts[slot]
    return rows


def build_map(docs: DataFrame, n_shards: int, n_slots: int = N_SLOTS, path: str | None = None) -> tuple[str, int]:
    """Aggregates bytes by slot, stores the map's versions 0 and 1 under path; returns the path and the last version.

    Only n_slots rows of counts reach the driver, whatever the input's size.
    """
    spark = docs.sparkSession
    path = path or shared_path(spark, "slotmap")
    sizes, counts = [0] * n_slots, [0] * n_slots
    used = docs.select(virtual_slot(F.col("doc_id"), n_slots).alias("vslot"), record_size(F.col("text")).alias("size"))
    for slot, size, n in used.groupBy("vslot").agg(F.sum("size"), F.count("*")).collect():
        sizes[slot], counts[slot] = size, n
    first = [slot % n_shards for slot in range(n_slots)]
    rows = map_rows(0, first, sizes, counts, n_shards) + map_rows(1, rebalanced(first, sizes, n_shards), sizes, counts, n_shards)
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.partitionBy("version").parquet(path)
    return path, 1


def shard(docs: DataFrame, path: str, version: int, n_slots: int = N_SLOTS) -> DataFrame:
    """docs' doc_id, size, text_crc32, vslot, shard and place under a stored map.

    Places are numbered within a virtual slot, never within a whole shard, and moved up by the
    rows of the shard's earlier slots. The broadcast map has n_slots rows.
    """
    slots = docs.sparkSession.read.parquet(path).where(F.col("version") == version).select("vslot", "shard", "first_place")
    rows = docs.select(
        "doc_id",
        record_size(F.col("text")).alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
        virtual_slot(F.col("doc_id"), n_slots).alias("vslot"),
    )
    within = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("n", F.row_number().over(within))
        .join(F.broadcast(slots), "vslot")
        .withColumn("place", F.col("first_place") + F.col("n") - 1)
        .select("doc_id", "size", "text_crc32", "vslot", "shard", "place")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: all documents in shards 0 to 23 of near equal bytes; slot: the row's place in its shard."""
    docs = documents(spark, sf_dir)
    placed = shard(docs, *build_map(docs, 24))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("place").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("vslot").alias("virtual_slot"),
    )
