"""Evaluation: STR10 flags, JON3 / EVL2 row results, AGG9-13 metrics,
PLT1-2 plot data, EVL1 evaluation of a prediction frame.

Every metric comes from one table of confusion counts
``(model, truth, prediction, n)``: labels are normalised once, and the counts
aggregate map-side (a majority class is one row per task before the
shuffle). Per-class and summary metrics are computed on that table, whose
size is bounded by models x classes^2, never by the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .validate import require_columns

TRUTH = "ground_truth"
BASELINE = "baseline_prediction"
FINETUNED = "finetuned_prediction"
# Model names of the comparison table.
MODEL_NAMES = {BASELINE: "Baseline", FINETUNED: "Fine-tuned"}
DIGITS = 10


def clean_predictions(df: DataFrame, columns: list[str]) -> DataFrame:
    """STR9 on each prediction column."""
    for c in columns:
        df = df.withColumn(c, T.clean_prediction(c))
    return df


def results_table(df: DataFrame, truth: str = TRUTH, finetuned: str = FINETUNED,
                  baseline: str | None = BASELINE, mode: str = "normalized") -> DataFrame:
    """EVL2: source columns + truth, predictions and correct flags per row.

    Rows stay keyed by their own columns; nothing is zipped by position.
    """
    require_columns(df, [truth, finetuned] + ([baseline] if baseline else []), "prediction DataFrame")
    drop = {truth, finetuned, "baseline_correct", "finetuned_correct"} | ({baseline} if baseline else set())
    source = [c for c in df.columns if c not in drop]
    cols = [*source, F.col(truth).alias(TRUTH)]
    if baseline:
        cols += [F.col(baseline).alias(BASELINE),
                 T.labels_match(truth, baseline, mode).alias("baseline_correct")]
    cols += [F.col(finetuned).alias(FINETUNED), T.labels_match(truth, finetuned, mode).alias("finetuned_correct")]
    return df.select(*cols)


def long_predictions(df: DataFrame, truth: str = TRUTH, models: dict[str, str] | None = None) -> DataFrame:
    """(model, truth, prediction) with normalised labels, one row per input
    row and model (``stack``, no join)."""
    models = models or {c: MODEL_NAMES.get(c, c) for c in (BASELINE, FINETUNED) if c in df.columns}
    pairs = F.array(*[F.struct(F.lit(name).alias("model"), T.normalize_label(col).alias("prediction"))
                      for col, name in models.items()])
    return df.select(T.normalize_label(truth).alias("truth"), F.explode(pairs).alias("p")).select(
        "p.model", "truth", "p.prediction")


def confusion_counts(long_df: DataFrame) -> DataFrame:
    """(model, truth, prediction, n): the only pass over the rows."""
    return long_df.groupBy("model", "truth", "prediction").agg(F.count("*").alias("n"))


def per_class(counts: DataFrame) -> DataFrame:
    """Per model and class (union of truth and predicted classes): tp,
    support, predicted, precision, recall, f1 (zero division -> 0).

    Each count cell contributes to its truth class (support, tp) and to its
    predicted class (predicted); both contributions come from one ``explode``
    and are summed by one aggregation, so the union of classes needs no join.
    """
    zero = F.lit(0).cast("bigint")
    n = F.col("n").cast("bigint")
    sides = F.array(
        F.struct(F.col("truth").alias("class"), n.alias("support"),
                 F.when(F.col("truth") == F.col("prediction"), n).otherwise(zero).alias("tp"),
                 zero.alias("predicted")),
        F.struct(F.col("prediction").alias("class"), zero.alias("support"), zero.alias("tp"),
                 n.alias("predicted")))
    j = (counts.select("model", F.explode(sides).alias("s")).select("model", "s.*")
         .groupBy("model", "class")
         .agg(F.sum("support").alias("support"), F.sum("tp").alias("tp"), F.sum("predicted").alias("predicted")))

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))

    return j.select(
        "model", "class", F.col("tp").cast("bigint").alias("tp"),
        F.col("support").cast("bigint").alias("support"), F.col("predicted").cast("bigint").alias("predicted"),
        ratio(F.col("tp"), F.col("predicted")).alias("precision"),
        ratio(F.col("tp"), F.col("support")).alias("recall"),
        ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"),
    )


def metrics(counts: DataFrame, average: str = "weighted") -> DataFrame:
    """AGG10/AGG11: per model n, accuracy, precision, recall, f1.

    ``weighted``: per-class values weighted by support; ``macro``: plain mean
    over the union of classes; ``micro``: all equal accuracy.
    """
    pc = per_class(counts)
    if average == "weighted":
        def avg(c): return F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support"))
    elif average == "macro":
        def avg(c): return F.avg(c)
    elif average == "micro":
        def avg(c): return F.try_divide(F.sum("tp").cast("double"), F.sum("support"))
    else:
        raise ValueError(f"unsupported average: {average!r}")
    out = pc.groupBy("model").agg(
        F.sum("support").cast("bigint").alias("samples"),
        F.try_divide(F.sum("tp").cast("double"), F.sum("support")).alias("accuracy"),
        avg("precision").alias("precision"), avg("recall").alias("recall"), avg("f1").alias("f1"))
    return out.select("model", *[F.round(F.coalesce(F.col(c), F.lit(0.0)), DIGITS).alias(c)
                                 for c in ("accuracy", "precision", "recall", "f1")], "samples")


def compare_models(df: DataFrame, truth: str = TRUTH, models: dict[str, str] | None = None,
                   average: str = "weighted") -> DataFrame:
    """AGG11: one row per model, any number of models, one job."""
    return metrics(confusion_counts(long_predictions(df, truth, models)), average)


def metric_long(metrics_df: DataFrame) -> DataFrame:
    """PLT2: (model, metric, value) for the grouped bar chart."""
    names = ["accuracy", "precision", "recall", "f1"]
    return metrics_df.select("model", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in names])).alias("m")).select(
        "model", "m.metric", "m.value")


def confusion_matrix(counts: DataFrame, model: str | None = None) -> DataFrame:
    """AGG12 / PLT1 (long, sparse): cells (truth, prediction, n) whose truth
    and prediction are both truth classes; absent cells are 0. Predictions
    outside the truth classes are not counted: a semi-join on the distinct
    (model, truth) pairs, so no group is gathered.
    """
    c = counts if model is None else counts.filter(F.col("model") == model)
    known = c.select("model", F.col("truth").alias("prediction")).distinct()
    return c.join(known, ["model", "prediction"], "left_semi").select("model", "truth", "prediction", "n")


def confusion_matrix_wide(counts: DataFrame, classes: list[str]) -> DataFrame:
    """AGG12 (wide): one row per model and class of ``classes``, one column per
    class, zeros filled, also for a class that no row has; predictions outside
    the classes are not counted. The classes are normalised like the labels
    (and named once each). The long form serves label sets too large for columns.
    """
    wanted = counts.sparkSession.createDataFrame([(c,) for c in classes], "c string")
    names = sorted({r[0] for r in wanted.select(T.normalize_label("c")).collect()})
    cells = [F.sum(F.when(F.col("prediction") == F.lit(c), F.col("n")).otherwise(F.lit(0))).cast("bigint").alias(c)
             for c in names]
    # A zero count per model and class gives each its row.
    zeros = counts.select("model").distinct().select(
        "model", F.explode(F.array(*[F.lit(c) for c in names])).alias("truth"),
        F.lit(None).cast("string").alias("prediction"), F.lit(0).cast("bigint").alias("n"))
    rows = counts.filter(F.col("truth").isin(names)).select("model", "truth", "prediction", "n")
    return rows.unionByName(zeros).groupBy("model", "truth").agg(*cells)


OTHER = "[other]"


def confusion_matrix_observed(counts: DataFrame, classes: list[str] | None = None, max_classes: int = 500) -> DataFrame:
    """AGG12 (wide) that loses no row: one row per model and truth class, a
    column per class and the column ``[other]`` for all other predictions.

    ``classes`` defaults to the observed truths, found by a pass that is
    bounded by ``max_classes`` (more is an error: use the long form). With
    given classes, rows of any other truth count under the truth ``[other]``.
    The cells of a model add up to its rows. A class named ``[other]`` is an error.
    """
    if classes is None:
        seen = counts.select("truth").distinct().limit(max_classes + 1).collect()
        names = sorted(r[0] for r in seen)
    else:
        wanted = counts.sparkSession.createDataFrame([(c,) for c in classes], "c string")
        names = sorted({r[0] for r in wanted.select(T.normalize_label("c")).collect()})
    if len(names) > max_classes:
        raise ValueError(f"more than {max_classes} truth classes: use confusion_matrix")
    if OTHER in names:
        raise ValueError(f"a class is named {OTHER}")
    named = lambda c: F.when(F.col(c).isin(names), F.col(c)).otherwise(OTHER)
    grid = counts.select("model").distinct().select("model", F.explode(F.array(*[F.lit(c) for c in names])).alias("truth"),
                                                    F.lit(None).cast("string").alias("prediction"), F.lit(0).cast("bigint").alias("n")) if names else None
    cells = counts.select("model", named("truth").alias("truth"), named("prediction").alias("prediction"), "n")
    cells = cells if grid is None else cells.unionByName(grid)
    return cells.groupBy("model", "truth").pivot("prediction", [*names, OTHER]).agg(F.sum("n")).na.fill(0)


def classification_report(counts: DataFrame) -> DataFrame:
    """AGG13: per class precision, recall, f1, support, plus the accuracy,
    macro avg and weighted avg rows; per model."""
    pc = per_class(counts)
    cls = pc.select("model", "class", "precision", "recall", "f1", "support")
    summary = pc.groupBy("model").agg(
        F.sum("support").alias("n"), F.sum("tp").alias("tp"),
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        F.try_divide(F.sum(F.col("precision") * F.col("support")), F.sum("support")).alias("wp"),
        F.try_divide(F.sum(F.col("recall") * F.col("support")), F.sum("support")).alias("wr"),
        F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("wf"))
    acc = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("n")), F.lit(0.0))
    rows = F.array(
        F.struct(F.lit("accuracy").alias("class"), F.lit(None).cast("double").alias("precision"),
                 F.lit(None).cast("double").alias("recall"), acc.alias("f1"), F.col("n").alias("support")),
        F.struct(F.lit("macro avg").alias("class"), F.col("mp").alias("precision"), F.col("mr").alias("recall"),
                 F.col("mf").alias("f1"), F.col("n").alias("support")),
        F.struct(F.lit("weighted avg").alias("class"), F.col("wp").alias("precision"), F.col("wr").alias("recall"),
                 F.col("wf").alias("f1"), F.col("n").alias("support")),
    )
    extra = summary.select("model", F.explode(rows).alias("r")).select("model", "r.*")
    out = cls.unionByName(extra)
    return out.select("model", "class", *[F.round(F.col(c), DIGITS).alias(c) for c in ("precision", "recall", "f1")],
                      F.col("support").cast("bigint").alias("support"))


def sample_accuracy(df: DataFrame, correct: str = "finetuned_correct") -> DataFrame:
    """AGG9: mean of the correct flag."""
    return df.agg(F.count("*").alias("samples"),
                  F.round(F.coalesce(F.avg(F.col(correct).cast("double")), F.lit(0.0)), DIGITS).alias("accuracy"))


def prediction_results(df: DataFrame, truth: str = TRUTH, finetuned: str = FINETUNED,
                       baseline: str | None = BASELINE, mode: str = "normalized") -> DataFrame:
    """EVL1 first half: clean the prediction columns and build the row
    results (EVL2)."""
    require_columns(df, [truth, finetuned] + ([baseline] if baseline else []), "prediction DataFrame")
    cleaned = clean_predictions(df, [finetuned] + ([baseline] if baseline else []))
    return results_table(cleaned, truth, finetuned, baseline, mode)


def evaluate_predictions(df: DataFrame, truth: str = TRUTH, finetuned: str = FINETUNED,
                         baseline: str | None = BASELINE, average: str = "weighted",
                         mode: str = "normalized") -> tuple[DataFrame, DataFrame]:
    """EVL1: clean the prediction columns, build row results and the model
    comparison. Returns (results, metrics)."""
    results = prediction_results(df, truth, finetuned, baseline, mode)
    models = {FINETUNED: MODEL_NAMES[FINETUNED]}
    if baseline:
        models = {BASELINE: MODEL_NAMES[BASELINE], **models}
    return results, compare_models(results, TRUTH, models, average)
