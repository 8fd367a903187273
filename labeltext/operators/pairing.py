"""JON3 + COL5: truths and predictions from two tables, paired by key.

Each side is first reduced to one row per key (the smallest one, and how many
there were), so that a repeated key, however hot, meets the join once and a
pair is never multiplied. The full outer join reuses the partitioning of those
two aggregations: one shuffle a side gives the pairs and the verdict on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage_table
from .validate import require_columns

STATUS = "pair_status"
PAIRED = "paired"
# What keeps a key from being a pair, in the order in which it is judged.
FAULTS = ["no_key", "missing_prediction", "missing_truth", "repeated_key"]


def pair_by_key(truths: DataFrame, predictions: DataFrame, key: str = "job_id") -> DataFrame:
    """One row per key of either table: the key, the other columns of both (of
    a repeated key's smallest row), ``truth_rows``, ``prediction_rows`` and ``pair_status``.

    ``paired``: one row on each side. Rows without a key are all reported
    under one row a side with the status ``no_key``; they are never paired.
    """
    require_columns(truths, [key], "truths")
    require_columns(predictions, [key], "predictions")
    clash = sorted((set(truths.columns) & set(predictions.columns)) - {key})
    if clash:
        raise ValueError(f"truths and predictions both have the columns {clash}")

    def one_per_key(df: DataFrame, name: str) -> DataFrame:
        rest = [c for c in df.columns if c != key]
        row = F.min(F.struct(*rest)) if rest else F.lit(None).cast("struct<none:int>")
        return df.groupBy(key).agg(row.alias(f"_{name}"), F.count("*").alias(f"{name}_rows"))

    both = one_per_key(truths, "truth").join(one_per_key(predictions, "prediction"), key, "full")
    t, p = F.coalesce("truth_rows", F.lit(0)), F.coalesce("prediction_rows", F.lit(0))
    status = (F.when(F.col(key).isNull(), FAULTS[0]).when(p == 0, FAULTS[1]).when(t == 0, FAULTS[2])
              .when((t > 1) | (p > 1), FAULTS[3]).otherwise(PAIRED))
    fields = [F.col(f"_{name}")[c].alias(c) for name, df in (("truth", truths), ("prediction", predictions))
              for c in df.columns if c != key]
    return both.select(key, *fields, t.alias("truth_rows"), p.alias("prediction_rows"), status.alias(STATUS))


def pairing_verdict(pairs: DataFrame) -> DataFrame:
    """One row: keys by status, and the rows behind the faulty ones."""
    faulty = F.col(STATUS) != PAIRED
    rows = F.col("truth_rows") + F.col("prediction_rows")
    return pairs.agg(
        *[F.count_if(F.col(STATUS) == s).alias(s) for s in [PAIRED, *FAULTS]],
        F.coalesce(F.sum(F.when(faulty, rows)), F.lit(0)).cast("bigint").alias("faulty_rows"))


def paired_rows(truths: DataFrame, predictions: DataFrame, key: str = "job_id") -> DataFrame:
    """The pairs alone, or an error that counts the faults. The join is written
    once; the verdict and every later reader start from that table, so a
    faulty pairing stops a job before it writes any metric."""
    pairs = stage_table(pair_by_key(truths, predictions, key), "pairs")
    verdict = pairing_verdict(pairs).first().asDict()
    bad = {k: verdict[k] for k in FAULTS if verdict[k]}
    if bad:
        raise ValueError(f"predictions and truths do not pair by {key}: {bad}, {verdict['faulty_rows']} rows")
    return pairs.drop("truth_rows", "prediction_rows", STATUS)
