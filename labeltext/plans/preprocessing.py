"""PIP1: the preprocessing job (clean -> label -> split -> write -> summary).

Each stage's output is written to ``output_dir`` and read back for the next
stage: the written table is the lineage cut (a lost executor replays one
stage, not the whole chain) and downstream stages scan Parquet with pruning
instead of re-running the regex cleaning.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import clean as C
from ..operators import labels as L
from ..operators import rank as R
from ..sinks.writers import run_manifest, write_table


@dataclass(frozen=True)
class PreprocessingConfig:
    min_description_words: int = 50
    train_ratio: float = 0.80
    validation_ratio: float = 0.10
    random_seed: int = 42
    entities: str = "auto"
    fmt: str = "parquet"


def pipeline_summary(postings: DataFrame, training: DataFrame, train_ratio: float = 0.80,
                     validation_ratio: float = 0.10) -> DataFrame:
    """AGG15: one row of stage counts from one pass over the labelled set.

    Cleaned postings = labelled-set rows (the label join is a left join on
    the posting key); split sizes follow from the number of splittable rows
    alone, so nothing is ranked. The raw count is a scalar subquery (a
    metadata-cheap count of the input).
    """
    lab = training.agg(
        F.count("*").alias("n"), F.count("skill_name").alias("labeled"),
        F.count_if(F.col("skill_name").isNotNull() & (T.py_strip(F.col("skill_name").cast("string")) != ""))
        .alias("splittable"))
    nd = F.col("splittable").cast("double")
    train_end = F.floor(nd * F.lit(float(train_ratio))).cast("bigint")
    val_end = F.floor(nd * F.lit(float(train_ratio + validation_ratio))).cast("bigint")
    return lab.select(
        postings.select(F.count("*")).scalar().alias("original_postings"),
        F.col("n").alias("cleaned_postings"),
        F.col("n").alias("training_dataset_rows"),
        F.col("labeled").alias("labeled_rows"),
        F.coalesce(F.try_divide(F.col("labeled").cast("double"), F.col("n")), F.lit(0.0)).alias("label_coverage"),
        train_end.alias("train_rows"),
        (val_end - train_end).alias("validation_rows"),
        (F.col("splittable") - val_end).alias("test_rows"),
    )


def run_preprocessing_pipeline(spark: SparkSession, postings: DataFrame, job_skills: DataFrame,
                               skills: DataFrame, output_dir: str,
                               config: PreprocessingConfig = PreprocessingConfig()) -> dict[str, object]:
    """Run the whole job; returns output paths and the summary row (dict)."""
    base = output_dir.rstrip("/")
    fmt = config.fmt

    def hand_over(name: str, df: DataFrame) -> DataFrame:
        """Write a table; the next stage reads Parquet, whatever the format asked
        for, so that quotes, commas and types survive."""
        if fmt == "parquet":
            paths[name] = write_table(df, f"{base}/{name}", fmt)
            return spark.read.parquet(paths[name])
        kept = spark.read.parquet(write_table(df, f"{base}/_stage/{name}", "parquet"))
        paths[name] = write_table(kept, f"{base}/{name}", fmt)
        return kept

    paths = {}
    # Stage 1: every posting cleaned and marked, the only scan of the input; the
    # cleaned table, the report and the counts all start from this table.
    paths["_marked"] = write_table(
        C.mark_postings(postings, config.min_description_words, config.entities), f"{base}/_stage/marked", "parquet")
    marked = spark.read.parquet(paths["_marked"])
    cleaned = hand_over("cleaned_postings", C.finish_postings(C.marked_candidates(marked, config.min_description_words)))
    report = C.cleaning_report(None, config.min_description_words, cleaned=cleaned, marked=marked)
    paths["cleaning_report"] = write_table(report, f"{base}/cleaning_report", fmt)
    training = hand_over("training_dataset", L.build_training_dataset(cleaned, job_skills, skills))
    splits = R.split_dataset(training, config.train_ratio, config.validation_ratio, config.random_seed)
    paths["splits"] = write_table(splits, f"{base}/splits", fmt, ["split"])
    # Counts of written tables, not observed metrics: those count a task twice
    # that ran again after a lost executor. Parquet keeps row counts in its footers.
    summary = pipeline_summary(marked, training, config.train_ratio, config.validation_ratio)
    paths["summary"] = write_table(summary, f"{base}/summary", "json")
    row = spark.read.json(paths["summary"]).first().asDict()
    manifest = run_manifest(spark, asdict(config), spark.read.json(paths["summary"]))
    paths["manifest"] = write_table(manifest, f"{base}/manifest", "json")
    return {"paths": paths, "summary": row}
