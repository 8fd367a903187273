"""EVL1 + SNK2: the evaluation job.

Reads a prediction file (CSV with a header; columns named as the reference's
evaluation script expects), renames the label columns to snake_case, cleans
the predictions, builds the row results and the model comparison, and writes
every output as a table: row results, metrics (Parquet and JSON records),
confusion cells and the classification report. The confusion counts are
computed once and persisted in the output folder; the metrics, matrix and
report are all derived from that small table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import evaluate as V
from ..operators.pairing import paired_rows
from ..operators.validate import require_columns
from ..sinks.writers import write_table
from ..sources.files import read_csv

# Column names of a prediction file as the reference writes
# and reads them, and our snake_case names.
FILE_COLUMNS = {
    "Ground Truth": V.TRUTH,
    "Baseline Prediction": V.BASELINE,
    "Fine-tuned Prediction": V.FINETUNED,
}


def read_prediction_file(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """SRC1 for a prediction file: NA tokens become NULL (so a missing
    prediction later scores as the class 'nan'), label columns renamed."""
    df = read_csv(spark, path, schema)
    for old, new in FILE_COLUMNS.items():
        if old in df.columns:
            df = df.withColumnRenamed(old, new)
    return df


def evaluation_job(spark: SparkSession, path: str, output_dir: str, schema: str | None = None,
                   baseline: bool = True, average: str = "weighted", truths_path: str | None = None,
                   truths_schema: str | None = None, key: str = "job_id") -> dict[str, str]:
    """EVL1: evaluate the prediction file at ``path``; returns output paths.

    With ``truths_path`` the truths come from a file of their own and are paired
    with the predictions by ``key``; a missing, extra or repeated key is an
    error before anything is written.
    """
    df = read_prediction_file(spark, path, schema)
    if truths_path is not None:
        truths = read_prediction_file(spark, truths_path, truths_schema)
        require_columns(truths, [key, V.TRUTH], "the truths")
        df = paired_rows(truths.select(key, V.TRUTH), df.drop(V.TRUTH), key)
    results, _ = V.evaluate_predictions(df, baseline=V.BASELINE if baseline else None, average=average)
    base = output_dir.rstrip("/")
    paths = {"results": write_table(results, f"{base}/results")}
    results = spark.read.parquet(paths["results"])
    models = {V.FINETUNED: V.MODEL_NAMES[V.FINETUNED]}
    if baseline:
        models = {V.BASELINE: V.MODEL_NAMES[V.BASELINE], **models}
    counts = V.confusion_counts(V.long_predictions(results, V.TRUTH, models))
    paths["confusion_counts"] = write_table(counts, f"{base}/confusion_counts")
    counts = spark.read.parquet(paths["confusion_counts"])
    metrics = V.metrics(counts, average)
    paths["metrics"] = write_table(metrics, f"{base}/metrics")
    paths["metrics_json"] = write_table(metrics, f"{base}/metrics_json", "json")
    paths["confusion_matrix"] = write_table(V.confusion_matrix(counts), f"{base}/confusion_matrix")
    paths["classification_report"] = write_table(V.classification_report(counts), f"{base}/classification_report")
    return paths
