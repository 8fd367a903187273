"""Sharding by fixed virtual slots.

Records are hashed into a fixed number of slots (thousands), bytes and rows are
aggregated per slot, and a versioned map says which shard owns each slot. The
hash never changes; rebalancing edits the map only. Version 1 deals the slots
out in equal ranges; every later version moves single slots from the fullest
to the emptiest shard until no move makes the two more equal.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labeltext.llm.staging import shared_path, stage

SLOTS = 4096


def slot_column(doc_id: F.Column, text_crc32: F.Column, slots: int) -> F.Column:
    """The record's slot. The text's checksum takes part so that rows without a
    doc_id, or with a repeated one, spread too."""
    return F.pmod(F.xxhash64(doc_id, text_crc32), F.lit(slots)).cast("int")


def first_map(slots: int, shards: int) -> list[int]:
    return [s * shards // slots for s in range(slots)]


def rebalance(owner: list[int], load: list[int], shards: int) -> list[int]:
    """An edited copy of the map ``owner`` (slot -> shard) whose shards carry
    nearly equal sums of ``load``. Shards may have been added. Each step moves
    the slot that best halves the gap between the fullest and the emptiest
    shard; it stops when no slot of the fullest makes the gap smaller."""
    owner = list(owner)
    total = [0] * shards
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(owner):
        total[shard] += load[slot]
        bisect.insort(held[shard], (load[slot], slot))
    while True:
        full = max(range(shards), key=lambda k: (total[k], -k))
        free = min(range(shards), key=lambda k: (total[k], k))
        gap = total[full] - total[free]
        at = bisect.bisect_left(held[full], (gap // 2, -1))
        near = [x for x in held[full][max(0, at - 1) : at + 1] if 0 < x[0] < gap]
        if not near:
            return owner
        best = min(near, key=lambda x: (abs(2 * x[0] - gap), x[1]))
        held[full].remove(best)
        bisect.insort(held[free], best)
        owner[best[1]] = free
        total[full] -= best[0]
        total[free] += best[0]


def store_map(spark: SparkSession, path: str, version: int, owner: list[int]) -> None:
    """Add a version of the map to the table at ``path``; the others stay."""
    rows = spark.createDataFrame(list(enumerate(owner)), "slot int, shard int").coalesce(1)
    rows.write.mode("overwrite").parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int) -> list[int]:
    """A stored version; as many rows as slots, so it fits the driver."""
    rows = spark.read.parquet(f"{path}/version={version}").collect()
    return [r["shard"] for r in sorted(rows, key=lambda r: r["slot"])]


def assign(docs: DataFrame, shards: int, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot, shard, position, map_version)
    for every row of ``docs`` (doc_id, text; other columns are ignored).

    ``size`` is the UTF-8 bytes of the text plus 1 (null: 1, checksum 0).
    ``position`` counts a shard's rows from 0 without gaps, slot by slot and by
    doc_id (nulls first), checksum and size within a slot; rows equal in all
    three take consecutive positions. Map versions 1 and 2 are stored at
    ``map_path`` (default: a new path in the shared folder), and version 2 is
    used. An empty table gives no rows and two equal versions of the map.

    Only ``slots`` sums reach the driver. Texts are read once and not shuffled;
    the skinny rows are shuffled by slot to number them.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    record = docs.select(F.col("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    record = stage(record.withColumn("virtual_slot", slot_column(F.col("doc_id"), F.col("text_crc32"), slots)), "slots-records")
    bytes_of, rows_of = [0] * slots, [0] * slots
    for r in record.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():
        bytes_of[r["virtual_slot"]], rows_of[r["virtual_slot"]] = r["b"], r["n"]
    path = map_path or shared_path(spark, "slot-map")
    owner = first_map(slots, shards)
    store_map(spark, path, 1, owner)
    owner = rebalance(owner, bytes_of, shards)
    store_map(spark, path, 2, owner)
    filled, entries = [0] * shards, []
    for slot, shard in enumerate(owner):
        entries.append((slot, shard, filled[shard]))
        filled[shard] += rows_of[slot]
    table = spark.createDataFrame(entries, "virtual_slot int, shard int, base long")
    order = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    numbered = record.withColumn("rank", F.row_number().over(order)).join(F.broadcast(table), "virtual_slot")  # as many rows as slots
    return numbered.select(
        "doc_id", "size", "text_crc32", "virtual_slot", "shard",
        (F.col("base") + F.col("rank") - 1).alias("position"), F.lit(2).alias("map_version"),
    )


def write_shards(docs: DataFrame, owner: list[int], path: str) -> None:
    """Write ``docs`` as one folder per shard under the map ``owner``, without
    a shuffle: every task adds a file to each folder."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slot = slot_column(F.col("doc_id"), F.crc32(text.cast("binary")), len(owner))
    shard = F.element_at(F.array(*[F.lit(s) for s in owner]), slot + 1)
    docs.withColumn("shard", shard).write.mode("overwrite").partitionBy("shard").parquet(path)
