"""Seeded total order without a single-partition sort: RNK1 (global_rank),
SPL1-2 (exact train/validation/test cut), SMP1-2 (exact sample).

The order
---------
Each row gets ``h = md5('<seed>:<id>')``; the order is (h, id). Rows fall in
buckets by the first ``bucket_digits`` hex digits of h (at most 16**digits
buckets, 65,536 by default). Bucket sizes are counted (partial aggregation:
one row per bucket per task before the shuffle) and their running sums taken
on that bounded table, which is then broadcast (size proven by the bucket
count, about 2 MB at 4 digits). md5 is uniform, so buckets are even.

Cutting by rank (split, sample)
-------------------------------
Labels that depend only on (rank, N) and are monotone in rank -- the split
name, "in the first n" -- are constant over every bucket except those that
straddle a cut point. Such buckets (at most one per cut) are the only rows
ranked; every other row takes its label from its bucket's offset, in the map
stage, with no shuffle of the rows at all. So the exact 80/10/10 cut costs one
skinny aggregate plus numbering ~2/65,536 of the rows.

Numbering (``number_rows``)
---------------------------
Buckets even out different ids, not equal ones: rows that repeat an id, or lack
one and agree in all columns, have one hash. Rows are therefore numbered by
ranges of (order, mark), the mark being a row's place in its input: any number
of rows with one hash is cut into several ranges. The sorted ranges are written
once; a range's offset is the number of rows in the ranges before it (a table
with a row per partition, broadcast), a row's number its offset plus its place.

The id should identify a row, but no row is lost if it does not: a row without
an id takes its hash from its other columns, and rows equal in hash and id are
ordered by the other columns. The permutation differs from NumPy's; sizes,
disjointness, coverage and repeatability are the contract.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from ..session import stage_table
from .validate import check_split_ratios, require_columns

RANK = "rank"
TOTAL = "total_rows"
_H, _B, _C, _OFF, _RN = "_h", "_b", "_c", "_off", "_rn"
_MARK, _PART, _AT, _FIRST, _SIZE, _SHIFT = "_mark", "_part", "_at", "_first_at", "_size", "_shift"
#: Offsets of at most 16**4 buckets (about 2 MB) are broadcast.
MAX_BUCKET_DIGITS = 4


def order_hash(id_col: str, seed: int, others: list[str] = ()) -> F.Column:
    """md5 of ``<seed>:<id>``; for a NULL id of the other columns' texts, each
    after a unit separator (U+001F), NULLs as empty."""
    values = [F.concat(F.lit("\x1f"), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in others]
    by_row = F.concat(F.lit(f"{seed}:"), *values)
    return F.md5(F.coalesce(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), by_row))


def _others(df: DataFrame, id_col: str) -> list[str]:
    """The columns besides the id that can be ordered, by name."""
    own = {RANK, TOTAL, _H, _B, _C, _OFF, _RN, _MARK, _PART, _AT, _FIRST, _SIZE, _SHIFT, "_first", "_uniform", "_skipped", id_col}
    return sorted(f.name for f in df.schema.fields if f.name not in own and not isinstance(f.dataType, (MapType, VariantType)))


def _keyed(df: DataFrame, id_col: str, seed: int, bucket_digits: int) -> DataFrame:
    if not 1 <= bucket_digits <= MAX_BUCKET_DIGITS:
        raise ValueError(f"bucket_digits must be between 1 and {MAX_BUCKET_DIGITS}")
    return df.withColumn(_H, order_hash(id_col, seed, _others(df, id_col))).withColumn(_B, F.substring(_H, 1, bucket_digits))


def bucket_offsets(keyed: DataFrame) -> DataFrame:
    """(_b, _c, _off, total_rows): rows per bucket, rows in earlier buckets,
    and N. At most 16**digits rows, so the global windows here are cheap."""
    counts = keyed.groupBy(_B).agg(F.count("*").alias(_C))
    whole = Window.orderBy(_B).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(
        _B, _C,
        F.coalesce(F.sum(_C).over(before), F.lit(0)).alias(_OFF),
        F.sum(_C).over(whole).alias(TOTAL),
    )


def number_rows(df: DataFrame, order: list[str], out_col: str) -> DataFrame:
    """``df`` plus ``out_col``: 1..N in the order of ``order`` (NULL first); rows
    equal in it are numbered in any order. Written once to the shared folder."""
    keys = [*order, _MARK]
    marked = df.withColumn(_MARK, F.monotonically_increasing_id())
    ranged = marked.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(_MARK)
    placed = stage_table(ranged.withColumn(_PART, F.spark_partition_id()).withColumn(_AT, F.monotonically_increasing_id()), "numbered")
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    ranges = placed.groupBy(_PART).agg(F.min(_AT).alias(_FIRST), F.count("*").alias(_SIZE))
    offsets = ranges.select(_PART, (F.coalesce(F.sum(_SIZE).over(before), F.lit(0)) - F.col(_FIRST) + 1).alias(_SHIFT))
    joined = placed.join(F.broadcast(offsets), _PART)  # a row per partition
    return joined.select(*df.columns, (F.col(_AT) + F.col(_SHIFT)).cast("bigint").alias(out_col))


def rank_table(df: DataFrame, id_col: str = "job_id", seed: int = 42) -> DataFrame:
    """(id, rank, total_rows) for every row of ``df``, rank in 1..N."""
    return global_rank(df.select(id_col), id_col, seed)


def global_rank(df: DataFrame, id_col: str = "job_id", seed: int = 42) -> DataFrame:
    """RNK1: ``df`` plus ``rank`` (1..N in the seeded order) and ``total_rows``."""
    others = _others(df, id_col)
    keyed = df.withColumn(_H, order_hash(id_col, seed, others))
    ranked = number_rows(keyed, [_H, id_col, *others], RANK).drop(_H)
    return ranked.withColumn(TOTAL, ranked.select(F.count("*")).scalar())


def cut_by_rank(df: DataFrame, label_of: Callable[[Column, Column], Column], out_col: str,
                id_col: str = "job_id", seed: int = 42, bucket_digits: int = 4) -> DataFrame:
    """``df`` plus ``out_col = label_of(rank, total_rows)`` without ranking
    every row. ``label_of`` must be non-NULL and monotone in rank (a step
    function), so a bucket whose first and last rank share a label is
    uniform. Only buckets that straddle a step are ranked. The bucket table
    is written once; the rows are read for it, for the straddling buckets and
    for the result."""
    keyed = _keyed(df, id_col, seed, bucket_digits)
    off = bucket_offsets(keyed)
    first = label_of(F.col(_OFF) + 1, F.col(TOTAL))
    last = label_of(F.col(_OFF) + F.col(_C), F.col(TOTAL))
    table = off.select(_B, _C, _OFF, TOTAL, first.alias("_first"), (first == last).alias("_uniform"))
    table = stage_table(table, "buckets")
    joined = keyed.join(F.broadcast(table.filter("_uniform").select(_B, "_first")), _B)
    uniform = joined.withColumn(out_col, F.col("_first")).select(*df.columns, out_col)
    # Straddling buckets: a row's rank is its bucket's offset plus its place among the bucket's rows.
    before = Window.orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    steps = table.filter("not _uniform")
    steps = steps.withColumn("_skipped", F.coalesce(F.sum(_C).over(before), F.lit(0))).select(_B, _OFF, TOTAL, "_skipped")
    edge = stage_table(keyed.join(F.broadcast(steps), _B), "straddling")
    numbered = number_rows(edge, [_H, id_col, *_others(df, id_col)], _RN)
    rank = F.col(_OFF) + F.col(_RN) - F.col("_skipped")
    edge = numbered.withColumn(out_col, label_of(rank, F.col(TOTAL))).select(*df.columns, out_col)
    return uniform.unionByName(edge)


def labeled_rows(training_df: DataFrame, label: str = "skill_name") -> DataFrame:
    """Rows that can be split: label present and not blank after stripping."""
    from ..functions import text as T

    require_columns(training_df, [label], "training_df")
    out = training_df.dropna(subset=[label]).withColumn(label, T.py_strip(F.col(label).cast("string")))
    return out.filter(F.col(label) != "")


def split_label(train_ratio: float = 0.80, validation_ratio: float = 0.10) -> Callable[[Column, Column], Column]:
    """Rank -> split name: cut points ``int(N * train)`` and
    ``int(N * (train + validation))``, in DOUBLE like Python floats."""
    def label(rank: Column, total: Column) -> Column:
        n = total.cast("double")
        train_end = F.floor(n * F.lit(float(train_ratio)))
        val_end = F.floor(n * F.lit(float(train_ratio + validation_ratio)))
        return (F.when(rank <= train_end, F.lit("train"))
                .when(rank <= val_end, F.lit("validation"))
                .otherwise(F.lit("test")))
    return label


def split_dataset(training_df: DataFrame, train_ratio: float = 0.80, validation_ratio: float = 0.10,
                  random_seed: int = 42, id_col: str = "job_id", label: str = "skill_name",
                  keep_rank: bool = False, bucket_digits: int = 4) -> DataFrame:
    """SPL1: one table with ``split`` in train/validation/test.

    Only the two buckets that hold a cut point are ranked (``cut_by_rank``);
    ``keep_rank`` ranks every row instead and keeps ``rank``/``total_rows``.
    """
    check_split_ratios(train_ratio, validation_ratio)
    rows = labeled_rows(training_df, label)
    label_of = split_label(train_ratio, validation_ratio)
    if keep_rank:
        ranked = global_rank(rows, id_col, random_seed)
        return ranked.withColumn("split", label_of(F.col(RANK), F.col(TOTAL)))
    return cut_by_rank(rows, label_of, "split", id_col, random_seed, bucket_digits)


def split_sizes(split_df: DataFrame) -> DataFrame:
    """SPL2: rows and share per split."""
    names = ["train", "validation", "test"]
    agg = split_df.agg(F.count("*").alias("_n"), *[F.count_if(F.col("split") == s).alias(s) for s in names])
    rows = [F.struct(F.lit(s).alias("split"), F.col(s).alias("rows"),
                     F.coalesce(F.round(F.try_divide(F.col(s).cast("double"), F.col("_n")), 10),
                                F.lit(0.0)).alias("share")) for s in names]
    return agg.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def sample_exact(df: DataFrame, sample_size: int | None, seed: int = 42, id_col: str = "job_id",
                 bucket_digits: int = 4) -> DataFrame:
    """SMP1/SMP2: exactly ``min(n, N)`` rows chosen by the seeded order;
    ``None`` returns every row; ``n <= 0`` is an error."""
    if sample_size is None:
        return df
    if sample_size <= 0:
        raise ValueError("the sample needs at least one row (or None for all rows)")
    marked = cut_by_rank(df, lambda rank, _total: rank <= F.lit(sample_size), "_in", id_col, seed, bucket_digits)
    return marked.filter(F.col("_in")).drop("_in")


SHARE_DIGITS = 13


def sample_approximate(df: DataFrame, share: float, seed: int = 42, id_col: str = "job_id") -> DataFrame:
    """SMP2 without a count: the rows whose seeded hash is below ``share``.

    A filter in the map stage: no pass to count rows, no shuffle, the same
    rows on any partitioning. The size is binomial: of N rows with ids of their
    own, within 4 * sqrt(N * share * (1 - share)) of N * share but for one run
    in 16,000. Samples are nested: a larger share of the same seed holds
    the smaller one. Rows that repeat an id, or lack one and agree in all
    columns, are in or out together.
    """
    if not 0 < share <= 1:
        raise ValueError("the share must be above 0 and at most 1")
    digits = F.substring(order_hash(id_col, seed, _others(df, id_col)), 1, SHARE_DIGITS)
    below = F.conv(digits, 16, 10).cast("bigint") < F.lit(int(share * 16**SHARE_DIGITS))
    return df.filter(below) if share < 1 else df
