"""Batch inference (INF1, INF2) with a pluggable predictor, and a Spark ML
text classifier (TRN1, re-aimed from adapter fine-tuning).

INF1 runs on ``mapInPandas``: each task builds the predictor once, receives
Arrow batches (``spark.sql.execution.arrow.maxRecordsPerBatch``), re-cuts
them into ``batch_size`` prompts, and returns (id, raw prediction). Output is
keyed by id, so row order never matters. Cleaning (STR9) runs afterwards on
the JVM.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import prompts as PR
from ..functions import text as T
from ..session import release_finished, stage_table
from .rank import sample_exact

Predictor = Callable[[list[str]], list[str]]


class AccentPredictor:
    """Keyword predictor shipped for tests and demos: the accent rule of the
    fixtures, answering in the verbose form a generative model uses
    (``Answer: fr.``) so that the cleaner has work to do."""

    def __init__(self, rules: list[tuple[str, str]] | None = None, default: str = "en",
                 template: str = "Answer: {}."):
        from ..sources.tables import ACCENT_RULE

        self.rules = [(lab, re.compile(p)) for lab, p in (rules or ACCENT_RULE)]
        self.default = default
        self.template = template

    def __call__(self, prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            label = next((lab for lab, rx in self.rules if p is not None and rx.search(p)), self.default)
            out.append(self.template.format(label))
        return out


def batch_predict(df: DataFrame, make_predictor: Callable[[], Predictor], input_col: str = "instruction",
                  id_col: str = "job_id", batch_size: int = 2, output_col: str = "raw_prediction") -> DataFrame:
    """INF1: (id, raw prediction) for every row; the predictor factory runs
    once per task, on the executor."""
    if batch_size <= 0:
        raise ValueError("batch_size must be positive")
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predictor = make_predictor()
        for pdf in batches:
            texts = pdf[input_col].tolist()
            preds: list[str] = []
            for start in range(0, len(texts), batch_size):
                preds.extend(predictor(texts[start:start + batch_size]))
            yield pd.DataFrame({id_col: pdf[id_col].values, output_col: preds})

    return df.select(id_col, input_col).mapInPandas(run, f"{id_col} {id_type}, {output_col} string")


MAX_INPUT_LENGTH, MAX_NEW_TOKENS = 512, 12


def generate_answers(df: DataFrame, make_predictor: Callable[[], Predictor], input_col: str = "instruction",
                     template: PR.ChatTemplate = PR.DEFAULT_TEMPLATE, max_input_length: int = MAX_INPUT_LENGTH,
                     max_new_tokens: int = MAX_NEW_TOKENS, batch_size: int = 2, output_col: str = "raw_prediction") -> DataFrame:
    """INF1 with its token limits: ``df`` plus the text given to the model
    (``model_input``) and its answer.

    The instruction becomes a user message with the generation marker. An input of
    more than ``max_input_length`` tokens loses its beginning, so the closing line
    and the marker stay; an answer is cut after ``max_new_tokens`` tokens (both
    whitespace tokens, on the JVM). ``predict_batch_udf`` keeps one predictor per
    Python worker and hands it ``batch_size`` inputs at a time. A NULL instruction
    is a NULL input and answer. A predictor's NULL answer stays NULL.
    """
    if batch_size <= 0 or max_new_tokens <= 0:
        raise ValueError("batch_size and max_new_tokens must be positive")

    def load():
        predictor = make_predictor()

        def predict(texts: np.ndarray) -> np.ndarray:
            asked = [t for t in texts if t is not None]
            answers = iter(predictor(asked) if asked else [])
            return np.array([None if t is None else next(answers) for t in texts], dtype=object)

        return predict

    ask = predict_batch_udf(load, return_type=StringType(), batch_size=batch_size)
    prompt = template.render(PR.chat_messages(input_col), add_generation_prompt=True)
    given = df.withColumn("model_input", F.when(F.col(input_col).isNotNull(), PR.keep_last_tokens(prompt, max_input_length)))
    return given.withColumn(output_col, PR.truncate_tokens(ask("model_input"), max_new_tokens))


def inference_job(eval_set: DataFrame, make_predictor: Callable[[], Predictor], sample_size: int | None = 20,
                  seed: int = 42, batch_size: int = 2, id_col: str = "job_id", label: str = "skill_name",
                  mode: str = "casefold", output_dir: str | None = None) -> DataFrame:
    """INF2: sample the evaluation set exactly, predict, clean, flag correct.

    The correct flag defaults to the inference script's rule (strip + lower).
    With ``output_dir`` the samples are written there (SNK3,
    ``prediction_samples``, Parquet) and the written table is returned, so the
    predictor runs once however often the result is read.
    """
    sample = sample_exact(eval_set, sample_size, seed, id_col)
    if sample.isEmpty():
        raise ValueError("No test rows are available for inference.")
    preds = batch_predict(sample, make_predictor, "instruction", id_col, batch_size)
    out = sample.join(preds, id_col).withColumn("prediction", T.clean_prediction("raw_prediction"))
    out = out.withColumn("correct", T.labels_match(label, "prediction", mode)).drop("raw_prediction")
    if output_dir is None:
        return out
    from ..sinks.writers import write_table

    path = write_table(out, f"{output_dir.rstrip('/')}/prediction_samples")
    return out.sparkSession.read.parquet(path)


#: File splits that one task of the optimiser reads at most.
SPLITS_PER_TASK = 8


def gradient_partitions(splits: int, cores: int) -> int:
    """Partitions for a pass of the optimiser over ``splits`` file splits: one per
    core, and more only where a task would read over ``SPLITS_PER_TASK`` splits."""
    return max(1, min(splits, max(cores, math.ceil(splits / SPLITS_PER_TASK))))


def merge_levels(partitions: int) -> int:
    """Levels of a tree of merges of four, so that the driver gets about four
    gradients however many partitions there are."""
    return max(2, round(math.log(max(partitions, 1), 4)))


def train_classifier(train: DataFrame, test: DataFrame, text_col: str = "description",
                     label_col: str = "skill_name", num_features: int = 1 << 18, max_iter: int = 20):
    """TRN1: fit TF-IDF + logistic regression on ``train`` and predict
    ``test``; returns (fitted PipelineModel, predictions with ``prediction_label``).

    Tokens are lower-cased words (``RegexTokenizer``); hashing keeps the
    feature space fixed, so no vocabulary is collected on the driver. The term
    counts are written once; the document frequencies and the regressions read
    them, so the words are cut once.

    One regression for each label against the rest, as the last stages of the model:
    the optimiser keeps some 30 vectors on the driver, and so they have the size
    of one label's weights, not of all. The label of the highest margin is
    predicted. The classes are the labels of ``train`` alone: a test row may have
    another label or none, which is never predicted, and a training row
    without a label teaches nothing.

    A pass of the optimiser makes one gradient of ``num_features`` per partition,
    so the rows are read in ``gradient_partitions``, not in one per file split, and
    merged until about four gradients are left for the driver.
    """
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, StringIndexer

    tok = RegexTokenizer(inputCol=text_col, outputCol="_tokens", pattern="\\W+", minTokenLength=1)
    tf = HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=num_features)
    counts = stage_table(tf.transform(tok.transform(train)).select(label_col, "_tf"), "train-counts")
    indexer = StringIndexer(inputCol=label_col, outputCol="label", handleInvalid="skip").fit(counts)
    idf = IDF(inputCol="_tf", outputCol="features").fit(counts)
    parts = gradient_partitions(counts.rdd.getNumPartitions(), counts.sparkSession.sparkContext.defaultParallelism)
    weighted = idf.transform(indexer.transform(counts)).select("label", "features").coalesce(parts)
    regressions = []
    for i in range(len(indexer.labels)):
        release_finished(counts.sparkSession)
        lr = LogisticRegression(maxIter=max_iter, regParam=0.01, aggregationDepth=merge_levels(parts), labelCol="_is",
                                rawPredictionCol=f"_margin{i}", probabilityCol=f"_probability{i}", predictionCol=f"_class{i}")
        regressions.append(lr.fit(weighted.select("features", (F.col("label") == i).cast("double").alias("_is"))))
    model = PipelineModel([indexer.setHandleInvalid("keep"), tok, tf, idf, *regressions])
    return model, label_predictions(model, test)


def label_predictions(model, df: DataFrame) -> DataFrame:
    """``df`` with the fitted pipeline's ``prediction`` (the index of the label of
    the highest margin, the first of equals) and ``prediction_label``."""
    from pyspark.ml.functions import vector_to_array

    labels = model.stages[0].labels
    margins = F.array(*[F.get(vector_to_array(f"_margin{i}"), F.lit(1)) for i in range(len(labels))])
    scored = model.transform(df).withColumn("prediction", F.array_position(margins, F.array_max(margins)).cast("double") - 1)
    names = F.array(*[F.lit(x) for x in labels])
    inner = [f"_{kind}{i}" for kind in ("margin", "probability", "class") for i in range(len(labels))]
    return scored.withColumn("prediction_label", F.get(names, F.col("prediction").cast("int"))).drop("_tokens", "_tf", "features", *inner)


def training_job(train: DataFrame, validation: DataFrame, output_dir: str, params: dict | None = None,
                 text_col: str = "description", label_col: str = "skill_name") -> dict[str, str]:
    """TRN1 + SNK4: fit, save the model, score both splits with it, and write
    ``train_metrics``, ``eval_metrics`` and ``training_metadata``. Returns
    name -> path. The scores come from the saved model, read back.

    Both frames need at least one row; the counts in the metadata are those of
    the scored tables.
    """
    import json

    from pyspark.ml import PipelineModel

    from ..sinks.writers import write_table
    from . import evaluate as V
    from .validate import require_rows

    spark, base, params = train.sparkSession, output_dir.rstrip("/"), params or {}
    require_rows(train, "the training split")
    require_rows(validation, "the validation split")
    model = train_classifier(train, validation, text_col, label_col, **params)[0]  # the frame of predictions would hold the fitted model
    paths = {"model": f"{base}/model"}
    model.write().overwrite().save(paths["model"])
    model = PipelineModel.load(paths["model"])
    release_finished(spark)
    rows = {}
    for name, part in (("train", train), ("eval", validation)):
        scored = label_predictions(model, part).select(F.col(label_col).alias(V.TRUTH), F.col("prediction_label").alias(V.FINETUNED))
        counts = V.confusion_counts(V.long_predictions(scored, models={V.FINETUNED: "Classifier"}))
        paths[f"{name}_metrics"] = write_table(V.metrics(counts), f"{base}/{name}_metrics")
        rows[f"{name}_rows"] = spark.read.parquet(paths[f"{name}_metrics"]).first()["samples"]
    meta = {"training_config": params, **rows, "spark_version": spark.version}
    paths["metadata"] = write_table(spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string"), f"{base}/training_metadata", "text")
    return paths
