"""Sinks: SNK1 (preprocessing tables), SNK2 (evaluation outputs), SNK3
(prediction samples), SNK4 (run manifest). Parquet by default; CSV with a
header and doubled quotes on request. Writes are idempotent (overwrite) so a
retried job leaves one copy."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> str:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "parquet":
        writer.parquet(path)
    elif fmt == "csv":
        writer.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    elif fmt == "json":
        writer.json(path)
    elif fmt == "text":
        writer.text(path)
    else:
        raise ValueError(f"unsupported format: {fmt!r}")
    return path


def write_tables(tables: dict[str, DataFrame], output_dir: str, fmt: str = "parquet",
                 partitioned: dict[str, list[str]] | None = None) -> dict[str, str]:
    """SNK1/SNK2/SNK3: one folder per named table; returns name -> path."""
    partitioned = partitioned or {}
    base = output_dir.rstrip("/")
    return {name: write_table(df, f"{base}/{name}", fmt, partitioned.get(name)) for name, df in tables.items()}


def run_manifest(spark: SparkSession, params: dict, counts: DataFrame | None = None) -> DataFrame:
    """SNK4: one-row run record: parameters (JSON), Spark version, and the
    row counts of a one-row counts frame when given."""
    base = spark.range(1).select(
        F.lit(json.dumps(params, sort_keys=True, default=str)).alias("params"),
        F.lit(spark.version).alias("spark_version"),
        F.current_timestamp().alias("created_at"))
    if counts is None:
        return base
    return base.select("*", F.struct(*[counts.select(c).scalar().alias(c) for c in counts.columns]).alias("counts"))
