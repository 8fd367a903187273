"""Spark session and shared-folder helpers.

Everything in the library takes a ``SparkSession`` (or a DataFrame) as an
argument; this module only supplies a sensible local session for tests and the
bench, and the one place that decides where intermediate tables may be written.
"""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "labeltext") -> SparkSession:
    """A local session configured the way the library expects a cluster to be.

    AQE (coalescing, skew-join splitting) and Arrow are on; the UI and
    PySpark's per-Column call-site capture are off.
    On a cluster, build the session yourself and keep these settings.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        # Plan building: PySpark otherwise records the Python call site of
        # every Column function for error messages, five JVM round trips per
        # call; off, a query's plan is built several times faster.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LABELTEXT_DRIVER_MEMORY", "8g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting must point at shared storage and is only read.
    When it is unset (local tests), a fresh folder is created under the system
    temp directory and registered, so ``DataFrame.checkpoint()`` works.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        current = spark.sparkContext.getCheckpointDir()
        if not current:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="labeltext-ckpt-")
    spark.conf.set("spark.checkpoint.dir", folder)
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it
    back. Use before an operator that passes over its input more than once
    (the seeded cut reads it for the bucket counts and again for the rows):
    the upstream work runs once, the lineage is cut, and the skinny pass
    reads only the columns it needs."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def release_finished(spark: SparkSession) -> None:
    """Let go of what finished jobs left: Spark frees their broadcast blocks, shuffle
    files and network buffers only when the driver collects its garbage, by itself
    after 30 minutes (``spark.cleaner.periodicGC.interval``) or with a full heap.
    For a loop over fits of many short jobs, between two fits."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
