"""Tables between the passes of an operator, in the cluster's shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, NumericType, StringType

from labeltext.session import ensure_checkpoint_dir

#: A side of at most this many rows and bytes is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 << 20


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under the folder that ``spark.checkpoint.dir`` names."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later passes start
    from the files, also after an executor is lost."""
    path = shared_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, a staged table, with a broadcast hint if it has at most ``max_rows``
    rows and ``max_bytes`` of values (one job over the staged files); else as it
    is, so that the join shuffles and AQE splits skewed keys."""
    size = F.lit(0)
    for f in df.schema.fields:
        text = f.dataType if isinstance(f.dataType, (StringType, BinaryType)) else None
        size = size + (8 if isinstance(f.dataType, NumericType) else F.coalesce(F.octet_length(F.col(f.name) if text else F.to_json(F.struct(f.name))), F.lit(0)))
    rows, held = df.agg(F.count("*"), F.sum(size)).first()
    return F.broadcast(df) if rows <= max_rows and (held or 0) <= max_bytes else df


def item_blocks(items: DataFrame, block_items: int, block_bytes: int, name: str = "items") -> Iterator[list[tuple[int, str]]]:
    """The distinct (item_id, text) with a text, in blocks that fit the driver; a block
    holds more than ``block_bytes`` only if one item alone does."""
    named = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text <> ''").distinct()
    named = stage(named.withColumn("size", F.octet_length("text")).withColumn("at", F.xxhash64("item_id", "text")), name)
    total = named.agg(F.count("*").alias("n"), F.sum("size").alias("b")).first()
    parts = max(1, -(-total["n"] // block_items), -(-(total["b"] or 0) // block_bytes))
    for p in range(parts):
        block, size = [], 0
        for row in named.where(F.pmod("at", F.lit(parts)) == p).toLocalIterator():
            if block and (len(block) >= block_items or size + row["size"] > block_bytes):
                yield block
                block, size = [], 0
            block.append((row["item_id"], row["text"]))
            size += row["size"]
        if block:
            yield block


def wide_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
