"""Labels: JON1 (bridge -> dimension), JON4 (unmapped codes), AGG1 (fold the
labels of a record), JON2 (attach to records), AGG2 (coverage), PIP3.

Scale notes
-----------
* The dimension is broadcast only behind a row-count proof
  (``sized_broadcast``); otherwise it is a shuffle join, and a hot code on the
  bridge side is split by AQE's skew-join handling.
* Folding groups by record id with ``collect_set``: the partial aggregate
  removes repeated labels per task before the shuffle, so a record holding a
  third of the bridge rows sends at most (distinct labels x tasks) values.
* The folded table comes out hash-partitioned by ``job_id``; joining it to
  records on ``job_id`` reuses that partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .common import sized_broadcast
from .validate import require_columns

LABEL_SEPARATOR = ", "


def map_labels(bridge: DataFrame, dimension: DataFrame, max_broadcast_rows: int = 1_000_000,
               keep_unmapped: bool = False) -> DataFrame:
    """JON1: bridge LEFT JOIN dimension on the code (NULL codes match, as in
    a pandas merge); unmapped rows are dropped unless ``keep_unmapped``."""
    require_columns(bridge, ["job_id", "skill_abr"], "job_skills")
    require_columns(dimension, ["skill_abr", "skill_name"], "skill_mapping")
    dim = sized_broadcast(
        dimension.select(F.col("skill_abr").alias("_code"), "skill_name"), max_broadcast_rows)
    joined = bridge.join(dim, bridge["skill_abr"].eqNullSafe(dim["_code"]), "left").drop("_code")
    return joined if keep_unmapped else joined.dropna(subset=["skill_name"])


def unmapped_codes(bridge: DataFrame, dimension: DataFrame, max_broadcast_rows: int = 1_000_000) -> DataFrame:
    """JON4: bridge rows whose code has no name, counted per code."""
    dim = sized_broadcast(dimension.select(F.col("skill_abr").alias("_code")).distinct(), max_broadcast_rows)
    missing = bridge.join(dim, bridge["skill_abr"].eqNullSafe(dim["_code"]), "left_anti")
    return missing.groupBy("skill_abr").agg(F.count("*").alias("rows"))


def fold_labels(mapped: DataFrame) -> DataFrame:
    """AGG1: per record, strip names, drop blanks, distinct, sort, join with
    ', '. A record whose names are all blank gets '' (not NULL)."""
    names = F.array_sort(F.filter(F.collect_set(T.py_strip("skill_name")), lambda x: x != ""))
    return (mapped.filter(F.col("job_id").isNotNull() & F.col("skill_name").isNotNull())
            .groupBy("job_id")
            .agg(F.array_join(names, LABEL_SEPARATOR).alias("skill_name")))


def attach_labels(records: DataFrame, folded: DataFrame) -> DataFrame:
    """JON2: records LEFT JOIN folded labels; unlabelled records keep NULL."""
    require_columns(records, ["job_id"], "cleaned_postings")
    return records.join(folded, "job_id", "left")


def build_training_dataset(records: DataFrame, bridge: DataFrame, dimension: DataFrame,
                           max_broadcast_rows: int = 1_000_000) -> DataFrame:
    """PIP3: map codes to names, fold per record, attach to the records."""
    return attach_labels(records, fold_labels(map_labels(bridge, dimension, max_broadcast_rows)))


def label_coverage(df: DataFrame, label: str = "skill_name") -> DataFrame:
    """AGG2: total rows, rows with a label ('' counts), share (0 when empty)."""
    return df.agg(F.count("*").alias("total_rows"), F.count(label).alias("labeled_rows")).select(
        "total_rows", "labeled_rows",
        F.coalesce(F.try_divide(F.col("labeled_rows").cast("double"), F.col("total_rows")),
                   F.lit(0.0)).alias("label_coverage"))


def label_distribution(df: DataFrame, label: str = "skill_name") -> DataFrame:
    """Count of records per folded label (NULL = unlabelled)."""
    return df.groupBy(label).agg(F.count("*").alias("rows"))
