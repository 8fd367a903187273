"""Readers for the parquet tables the driver provides, mapped onto the
reference's data model (postings, bridge, dimension, predictions, chat).

Every reader declares only the columns it needs, so Catalyst prunes the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import POSTING_COLUMNS

# Tables whose rows carry long text: per-row CPU (regex cleaning) dominates.
TEXT_TABLES = {"documents", "pages", "conversations", "benchmark"}


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-bound text stages at least ``defaultParallelism`` tasks.

    A scan yields one task per file split; a small or unsplittable input can
    leave cores idle. Only then is the input dealt round-robin (one exchange
    of the pruned columns); a scan that already has enough splits, as on a
    cluster reading many files, is returned unchanged.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < want:
        return df.repartition(want)
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def postings_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job postings built from ``documents``: the first line is the title and
    the whole text the description; the optional fields get gaps on purpose."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("job_id"),
        F.col("source").alias("company_name"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("description"),
        F.col("lang").alias("location"),
        F.when(F.col("doc_id") % 3 == 0, F.lit(None).cast("string"))
        .otherwise(F.col("source")).alias("formatted_work_type"),
        F.when(F.col("doc_id") % 5 == 0, F.lit(None).cast("string"))
        .otherwise(F.col("lang")).alias("formatted_experience_level"),
    ).select(*POSTING_COLUMNS)


def postings_from_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw HTML postings built from ``pages``."""
    p = table(spark, sf_dir, "pages")
    return p.select(
        F.col("page_id").alias("job_id"),
        F.lit(None).cast("string").alias("company_name"),
        F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"),
        F.col("html").alias("description"),
        F.col("url").alias("location"),
        F.lit(None).cast("string").alias("formatted_work_type"),
        F.lit(None).cast("string").alias("formatted_experience_level"),
    )


def bridge_from_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record-to-code bridge: one row for the quality code, one for toxic."""
    lab = table(spark, sf_dir, "labels")
    return lab.select(
        F.col("doc_id").alias("job_id"),
        F.explode(F.array(
            F.concat(F.lit("Q"), F.col("quality").cast("string")),
            F.concat(F.lit("T"), F.col("toxic").cast("string")),
        )).alias("skill_abr"),
    )


# The code -> name dimension of the fixtures (T0 unmapped on
# purpose; ' Low quality ' carries spaces on purpose).
SKILL_DIMENSION = [("Q1", "High quality"), ("Q0", " Low quality "), ("T1", "Toxic")]


def skill_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SKILL_DIMENSION, "skill_abr string, skill_name string")


def bridge_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bridge at size: order -> part code."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("job_id"), F.col("l_partkey").alias("skill_abr"))


def dimension_from_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("skill_abr"), F.col("p_type").alias("skill_name"))


def records_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus"), F.col("o_orderpriority"))


# The accent rule that stands in for a fine-tuned model.
ACCENT_RULE = [("fr", "[éèêç]"), ("de", "[äöüß]"), ("es", "[ñóíá]")]
DEFAULT_GUESS = "en"


def accent_guess(text_col) -> F.Column:
    out = F.lit(DEFAULT_GUESS)
    for lang, pattern in reversed(ACCENT_RULE):
        out = F.when(F.col(text_col).rlike(pattern), F.lit(lang)).otherwise(out)
    return out


def predictions_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prediction frame: truth = lang, baseline = 'en', fine-tuned = accent
    rule, wrapped as ``Answer: <UPPER>.`` on even ids to exercise the cleaner."""
    d = table(spark, sf_dir, "documents")
    guess = accent_guess("text")
    return d.select(
        F.col("doc_id").alias("job_id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("lang").alias("ground_truth"),
        F.lit(DEFAULT_GUESS).alias("baseline_prediction"),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Answer: "), F.upper(guess), F.lit(".")))
        .otherwise(guess).alias("finetuned_prediction"),
    )


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation / training input (job_id, title, description, skill_name):
    documents LEFT JOIN labels; the quality label names the class, unlabelled
    documents carry NULL."""
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return d.join(lab, "doc_id", "left").select(
        F.col("doc_id").alias("job_id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("description"),
        F.when(F.col("quality") == 1, F.lit("High quality"))
        .when(F.col("quality") == 0, F.lit("Low quality")).alias("skill_name"),
    )

