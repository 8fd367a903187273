"""Structured Streaming form of the row-level cleaning.

The reference only reads whole files; nothing in it is incremental. The
row-level part of the cleaning (project, drop missing, clean text, lengths,
minimum words, fill optional fields) is stateless, so the same Column
functions run unchanged on a streaming DataFrame. Deduplication stays a batch
step: "first" means the smallest id over the whole table, which a stream
cannot know before it ends; run ``operators.clean.finish_postings`` on the
sink table.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.clean import clean_candidates
from ..sources.schema import NOT_SPECIFIED, OPTIONAL_COLUMNS
from ..session import ensure_checkpoint_dir


def clean_stream(postings: DataFrame, min_description_words: int = 50, entities: str = "auto") -> DataFrame:
    """Cleaned candidate rows of a (streaming or batch) postings DataFrame,
    with the dedup key kept for the batch dedup."""
    df = clean_candidates(postings, min_description_words, entities)
    return df.na.fill({c: NOT_SPECIFIED for c in OPTIONAL_COLUMNS})


def start_cleaning_stream(spark: SparkSession, source_dir: str, schema: StructType, sink_dir: str,
                          checkpoint_dir: str | None = None, source_format: str = "parquet",
                          min_description_words: int = 50, available_now: bool = False,
                          max_files_per_trigger: int | None = None) -> StreamingQuery:
    """readStream(source) -> clean -> writeStream parquet (append).

    The checkpoint defaults to a folder under the shared
    ``spark.checkpoint.dir`` named after the sink, so a restarted query
    resumes where it stopped and two sinks never share one.
    """
    reader = spark.readStream.schema(schema).format(source_format)
    if source_format == "csv":
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = clean_stream(reader.load(source_dir), min_description_words)
    # one checkpoint per sink: the same sink resumes, another sink never shares state
    sink_tag = hashlib.sha1(sink_dir.rstrip("/").encode("utf-8")).hexdigest()[:16]
    ckpt = checkpoint_dir or f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/cleaning-{sink_tag}"
    writer = (stream.writeStream.format("parquet").option("path", sink_dir)
              .option("checkpointLocation", ckpt).outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def stream_row_counts(stream: DataFrame) -> DataFrame:
    """Running count of cleaned rows per location (a stateful aggregate; the
    state is one row per location)."""
    return stream.groupBy("location").agg(F.count("*").alias("rows"))
