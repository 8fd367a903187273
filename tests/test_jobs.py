"""COL1/COL4/COL5/COL6 checks, and the two jobs end to end (PIP1 + SNK1/SNK4,
EVL1 + SNK2), plus SRC2-4 file sniffing and search."""

import os

import pytest
from pyspark.sql import functions as F

from labeltext.operators import infer as I
from labeltext.operators import validate as VAL
from labeltext.plans import evaluation as EJ
from labeltext.plans import preprocessing as PP
from labeltext.plans.queries import REGISTRY
from labeltext.session import scratch_path
from labeltext.sinks import writers as W
from labeltext.sources import files as FS
from labeltext.sources import tables as S

SF = "/root/testdata/sf0.001"


def test_require_columns_lists_missing_and_available(spark):
    df = spark.createDataFrame([(1, "a")], "job_id bigint, title string")
    VAL.require_columns(df, ["job_id"], "postings")
    with pytest.raises(ValueError) as e:
        VAL.require_columns(df, ["job_id", "description"], "postings")
    assert "description" in str(e.value) and "title" in str(e.value) and "postings" in str(e.value)


@pytest.mark.parametrize("value,want", [(None, None), ("all", None), (" Full ", None), ("none", None),
                                        ("null", None), ("20", 20), (5, 5)])
def test_parse_optional_sample_size(value, want):
    assert VAL.parse_optional_sample_size(value) == want


@pytest.mark.parametrize("value", [0, -1, "0"])
def test_parse_optional_sample_size_rejects(value):
    with pytest.raises(ValueError):
        VAL.parse_optional_sample_size(value)


@pytest.mark.parametrize("train,val", [(0, 0.1), (1.0, 0.0), (0.8, 0.2), (0.5, -0.1), (0.9, 0.1)])
def test_split_ratio_guards(train, val):
    with pytest.raises(ValueError):
        VAL.check_split_ratios(train, val)


def test_require_rows(spark):
    empty = spark.createDataFrame([], "job_id bigint")
    with pytest.raises(ValueError):
        VAL.require_rows(empty, "test data")
    assert VAL.require_rows(spark.range(1), "x").count() == 1


def test_prediction_parity_counts(spark):
    t = spark.createDataFrame([(1,), (2,), (2,), (3,)], "job_id bigint")
    p = spark.createDataFrame([(1,), (3,), (3,), (3,), (4,)], "job_id bigint")
    r = VAL.prediction_parity(t, p).first().asDict()
    assert r == {"missing_predictions": 1, "missing_truths": 1, "repeated_truth_keys": 1,
                 "repeated_prediction_keys": 2}


def test_preprocessing_job_matches_queries(spark):
    out = scratch_path(spark, "pp-job")
    res = PP.run_preprocessing_pipeline(spark, S.postings_from_documents(spark, SF), S.bridge_from_labels(spark, SF),
                                        S.skill_dimension(spark), out)
    paths = res["paths"]
    cleaned = spark.read.parquet(paths["cleaned_postings"])
    assert sorted(map(tuple, cleaned.collect())) == sorted(map(tuple, REGISTRY["clean_postings"](spark, SF).collect()))
    splits = spark.read.parquet(paths["splits"]).select("job_id", "skill_name", "split")
    assert sorted(map(tuple, splits.collect())) == sorted(map(tuple, REGISTRY["split_dataset"](spark, SF).collect()))
    want = REGISTRY["pipeline_summary"](spark, SF).first().asDict()
    assert {k: res["summary"][k] for k in want} == want
    counts = spark.read.parquet(paths["splits"]).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in counts} == {
        "train": want["train_rows"], "validation": want["validation_rows"], "test": want["test_rows"]}
    assert os.path.isdir(paths["manifest"]) and os.path.isdir(paths["cleaning_report"])


def test_evaluation_job_from_csv(spark):
    src = scratch_path(spark, "pred-csv")
    rows = [(1, "Sales", "Answer: sales.", "IT"), (2, "IT", "it", "IT"), (3, "IT", "NA", "IT"),
            (4, "HR, Legal", "hr , legal", None)]
    frame = spark.createDataFrame(rows, "job_id bigint, `Ground Truth` string, `Fine-tuned Prediction` string, "
                                        "`Baseline Prediction` string")
    W.write_table(frame, src, "csv")
    paths = EJ.evaluation_job(spark, src, scratch_path(spark, "eval-out"),
                              "job_id BIGINT, `Ground Truth` STRING, `Fine-tuned Prediction` STRING, "
                              "`Baseline Prediction` STRING")
    m = {r.model: r for r in spark.read.parquet(paths["metrics"]).collect()}
    # fine-tuned: 1, 2 and 4 right; 3 is 'NA' -> missing -> 'nan' (wrong)
    assert m["Fine-tuned"].accuracy == 0.75 and m["Fine-tuned"].samples == 4
    assert m["Baseline"].accuracy == 0.5
    res = spark.read.parquet(paths["results"])
    assert set(res.columns) >= {"job_id", "ground_truth", "finetuned_prediction", "finetuned_correct",
                                "baseline_prediction", "baseline_correct"}
    assert {r.job_id: r.finetuned_prediction for r in res.collect()}[3] == "nan"
    report = spark.read.parquet(paths["classification_report"])
    assert report.filter(F.col("class") == "weighted avg").count() == 2
    assert spark.read.json(paths["metrics_json"]).count() == 2


def test_sniff_and_find_files(spark):
    root = scratch_path(spark, "files")
    os.makedirs(f"{root}/a/b")
    with open(f"{root}/a/train.csv", "w") as f:
        f.write("x\n1\n")
    with open(f"{root}/a/b/train.xls", "w") as f:
        f.write("x\n1\n")  # CSV text behind an .xls name
    with open(f"{root}/real.xlsx", "wb") as f:
        f.write(b"PK\x03\x04rest")
    with open(f"{root}/notes.md", "w") as f:
        f.write("hi")
    got = {os.path.basename(r.path): r.format for r in FS.sniff_files(spark, root).collect()}
    assert got == {"train.csv": "csv", "train.xls": "csv", "real.xlsx": "xlsx", "notes.md": "unsupported"}
    found = FS.find_file(spark, root, ["train.csv", "train.xls"]).collect()
    assert len(found) == 2 and all(r.matches == 2 for r in found)
    chosen = [r.path for r in found if r.chosen]
    assert len(chosen) == 1 and chosen[0] == min(r.path for r in found)


def test_inference_job_writes_samples(spark):
    from labeltext.operators import examples as X
    from labeltext.operators import infer as I

    ev = X.load_eval_set(S.labelled_documents(spark, SF))
    out = scratch_path(spark, "inference")
    written = I.inference_job(ev, I.AccentPredictor, 20, 42, output_dir=out)
    direct = I.inference_job(ev, I.AccentPredictor, 20, 42)
    assert os.path.isdir(f"{out}/prediction_samples")
    assert sorted(map(tuple, written.collect())) == sorted(map(tuple, direct.collect()))
    assert written.count() == 20


def test_classifier_predicts_labels_of_training_rows_only(spark):
    """One class in training: with a class of its own for unseen labels, the
    constant label was scored as that class, which has no name."""
    train = spark.createDataFrame([(i, f"good fine {i}", "yes") for i in range(6)], "job_id bigint, description string, skill_name string")
    test = spark.createDataFrame([(10, "good", "yes"), (11, "bad poor", "no"), (12, "other", None)], train.schema)
    model, scored = I.train_classifier(train, test, num_features=64, max_iter=3)
    assert {r.job_id: r.prediction_label for r in scored.collect()} == {10: "yes", 11: "yes", 12: "yes"}
    unlabelled = spark.createDataFrame([(20, "no label here", None)], train.schema)
    three = train.unionByName(unlabelled).unionByName(spark.createDataFrame([(30 + i, f"bad poor {i}", "no") for i in range(5)] + [(40 + i, f"soso {i}", "so") for i in range(5)], train.schema))
    model, scored = I.train_classifier(three, test, num_features=64, max_iter=3)
    assert len(model.stages[0].labels) == 3 and {r.prediction_label for r in scored.collect()} <= {"yes", "no", "so"}


def test_training_job_scores_one_label_and_unseen_ones(spark):
    schema = "job_id bigint, description string, skill_name string"
    train = spark.createDataFrame([(i, f"good fine {i}", "yes") for i in range(6)], schema)
    validation = spark.createDataFrame([(10, "good", "yes"), (11, "bad poor", "no")], schema)
    paths = I.training_job(train, validation, scratch_path(spark, "one-label"), {"num_features": 64, "max_iter": 3})
    assert spark.read.parquet(paths["train_metrics"]).first().accuracy == 1.0
    assert spark.read.parquet(paths["eval_metrics"]).first().accuracy == 0.5


def test_optimiser_sends_few_gradients(spark, monkeypatch):
    """One gradient per file split, and a fixed depth of merging, filled the driver's heap."""
    from pyspark.ml.classification import LogisticRegression

    fits, fit, released, release = [], LogisticRegression.fit, [], I.release_finished

    def noted(self, rows):
        fits.append((rows.rdd.getNumPartitions(), self.getAggregationDepth(), rows.count()))
        return fit(self, rows)

    monkeypatch.setattr(LogisticRegression, "fit", noted)
    monkeypatch.setattr(I, "release_finished", lambda session: (released.append(len(fits)), release(session)))
    cores, before = spark.sparkContext.defaultParallelism, spark.conf.get("spark.sql.files.maxPartitionBytes")
    train = spark.createDataFrame([(i, "good fine" if i % 2 else "bad poor", "yes" if i % 2 else "no") for i in range(120)],
                                  "job_id bigint, description string, skill_name string").repartition(24)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")  # a split for each file at least
    try:
        _, scored = I.train_classifier(train, train, num_features=64, max_iter=3)
        assert scored.filter("prediction_label = skill_name").count() == 120
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(fits) == 2 and released == [0, 1]  # before each fit
    for parts, levels, rows in fits:
        assert rows == 120 and parts < 24 and levels == I.merge_levels(parts)
    for splits in (1, 5, 24, 100, 10_000):
        parts = I.gradient_partitions(splits, cores)
        assert 1 <= parts <= splits and parts >= min(splits, cores) and parts * I.SPLITS_PER_TASK >= splits
    assert [I.merge_levels(n) for n in (1, 6, 16, 64, 1024)] == [2, 2, 2, 3, 5]
