"""Pairing of two tables, readers by content, rejected rows, conversations,
token limits, the matrix over observed truths, sketches and the training job."""

import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from labeltext.functions import prompts as PR
from labeltext.operators import chat as CH
from labeltext.operators import evaluate as V
from labeltext.operators import infer as I
from labeltext.operators import pairing as PA
from labeltext.operators import profile as P
from labeltext.session import scratch_path
from labeltext.sources import files as FS


def test_pairs_and_verdict(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (2, "a"), (3, "c"), (None, "d")], "job_id bigint, truth string")
    p = spark.createDataFrame([(1, "x"), (2, "y"), (4, "z"), (None, "w"), (None, "v")], "job_id bigint, guess string")
    pairs = PA.pair_by_key(t, p)
    rows = sorted(map(tuple, pairs.collect()), key=repr)
    assert rows == sorted([
        (1, "a", "x", 1, 1, "paired"), (2, "a", "y", 2, 1, "repeated_key"), (3, "c", None, 1, 0, "missing_prediction"),
        (4, None, "z", 0, 1, "missing_truth"), (None, "d", None, 1, 0, "no_key"), (None, None, "v", 0, 2, "no_key")], key=repr)
    assert PA.pairing_verdict(pairs).first().asDict() == {
        "paired": 1, "no_key": 2, "missing_prediction": 1, "missing_truth": 1, "repeated_key": 1, "faulty_rows": 8}
    with pytest.raises(ValueError, match="missing_prediction"):
        PA.paired_rows(t, p)
    good = PA.paired_rows(t.filter("job_id = 1"), p.filter("job_id = 1"))
    assert good.collect() == [(1, "a", "x")]
    with pytest.raises(ValueError, match="both have"):
        PA.pair_by_key(t, t)


def test_a_faulty_pairing_writes_no_metrics(spark):
    from labeltext.plans import evaluation as EJ
    from labeltext.sinks import writers as W

    base = scratch_path(spark, "pairs")
    W.write_table(spark.createDataFrame([(1, "a")], "job_id bigint, `Ground Truth` string"), f"{base}/t", "csv")
    W.write_table(spark.createDataFrame([(2, "a")], "job_id bigint, `Fine-tuned Prediction` string"), f"{base}/p", "csv")
    with pytest.raises(ValueError, match="do not pair"):
        EJ.evaluation_job(spark, f"{base}/p", f"{base}/out", baseline=False, truths_path=f"{base}/t")
    assert not os.path.exists(f"{base}/out")


def test_files_are_read_by_their_content(spark):
    root = scratch_path(spark, "content")
    os.makedirs(f"{root}/sub")
    files = {
        "a.csv": b"id,name\n1,one\n2,\"t\nwo\"\n", "sub/b.xls": b"\xef\xbb\xbfname,id,more\nthree,3,x\n", "c.csv.gz": gzip.compress(b"id,name\n4,NA\n"),
        "d.xlsx": b"PK\x03\x04 zip", "e.xls": b"\xd0\xcf\x11\xe0 ole", "f.csv": gzip.compress(b"id,name\n9,no\n"), "g.txt": b" \n", "h.md": b"id,name\n8,no\n",
        "i.csv": b"id,name\n\x00\x01",
    }
    for name, data in files.items():
        with open(f"{root}/{name}", "wb") as f:
            f.write(data)
    spark.createDataFrame([("five", 5)], "name string, id int").coalesce(1).write.parquet(f"{root}/p")
    rows, table = FS.read_by_content(spark, root, "id BIGINT, name STRING")
    assert sorted(map(tuple, rows.collect()), key=repr) == [(1, "one"), (2, "t\nwo"), (3, "three"), (4, None), (5, "five")]
    got = {os.path.basename(r.path): (r.format, r.status) for r in table.collect()}
    assert {k: got[k] for k in ("a.csv", "b.xls", "c.csv.gz")} == dict.fromkeys(("a.csv", "b.xls", "c.csv.gz"), ("csv", "read"))
    assert got["d.xlsx"] == ("xlsx", "rejected") and got["e.xls"] == ("xls", "rejected") and got["f.csv"] == ("gzip", "rejected")
    assert got["g.txt"] == ("csv", "rejected") and got["h.md"] == ("unsupported", "rejected") and got["i.csv"] == ("binary", "rejected")
    reasons = [r.reason for r in table.collect() if r.status == "rejected" and r.format != "unsupported"]
    assert all("as CSV:" in x and "as a workbook:" in x for x in reasons)
    with pytest.raises(ValueError, match="as a workbook"):
        FS.read_by_content(spark, f"{root}/d.xlsx", "id BIGINT")


def test_rejects_carry_their_causes(spark):
    path = scratch_path(spark, "rejects") + ".csv"
    with open(path, "w") as f:
        f.write('id,name,size\n1,"a, ""b""\nc",10\n2,short\n3,x,1,extra\nx4,bad,NA\n5,y,1e\n6,,7\n')
    checked = FS.read_csv_checked(spark, path, "id BIGINT, size BIGINT, name STRING")
    good, bad = FS.split_rejects(checked, scratch_path(spark, "split"))
    assert sorted(map(tuple, good.collect())) == [(1, 10, 'a, "b"\nc'), (6, 7, None)]
    causes = {tuple(r[FS.CAUSES]): r for r in bad.collect()}
    assert set(causes) == {("shape",), ("value:id",), ("value:size",)}
    assert sorted(r[FS.RECORD] for r in bad.filter("array_contains(_causes, 'shape')").collect()) == ["2,short", "3,x,1,extra"]
    assert good.count() + bad.count() == 6


def test_conversations_fold_in_order_and_render(spark):
    rows = [(1, 2, "user", "c"), (1, 0, "system", "a"), (1, 1, "user", None), (2, 0, "user", "q"), (2, 1, "assistant", "r"), (3, None, "assistant", "x"), (None, 1, None, "n")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3)
    t = PR.ChatTemplate("<{role}>", ";", "<assistant>")
    got = {r.conv_id: (r.n_messages, r.full_text, r.prompt_text) for r in CH.render_conversation(CH.fold_conversation(df), template=t).collect()}
    assert got == {
        1: (3, "<system>a;<user>;<user>c;", "<system>a;<user>;<user>c;<assistant>"), 2: (2, "<user>q;<assistant>r;", "<user>q;<assistant>"),
        3: (1, "<assistant>x;", "<assistant>"), None: (1, "<>n;", "<>n;<assistant>")}


def test_answers_keep_to_their_token_limits(spark):
    rows = [(1, "w " * 500 + "the closing line."), (2, "short"), (3, None), (4, "mute"), (5, "")]
    df = spark.createDataFrame(rows, "job_id bigint, instruction string")
    make = lambda: lambda prompts: [None if "mute" in p else p for p in prompts]
    out = {r.job_id: r for r in I.generate_answers(df, make, max_input_length=20, max_new_tokens=3, batch_size=2).collect()}
    assert out[1].model_input.split()[-4:] == ["the", "closing", "line.<|end|>", "<|assistant|>"] and len(out[1].model_input.split()) == 20
    assert out[1].raw_prediction.split() == out[1].model_input.split()[:3]
    assert out[2].model_input == "<|user|> short<|end|> <|assistant|>"
    assert out[3].model_input is None and out[3].raw_prediction is None and out[4].raw_prediction is None
    assert out[5].model_input.endswith("<|assistant|>")
    for bad in ({"batch_size": 0}, {"max_new_tokens": 0}, {"max_input_length": 0}):
        with pytest.raises(ValueError):
            I.generate_answers(df, make, **bad)


def test_observed_matrix_loses_no_row(spark):
    rows = [("a", "a", 3), ("a", "zz", 2), ("b", "a", 1), ("c", "c", 4)]
    counts = spark.createDataFrame([("m", *r) for r in rows], "model string, truth string, prediction string, n bigint")
    got = {r.truth: r.asDict() for r in V.confusion_matrix_observed(counts).collect()}
    assert got["a"] == {"model": "m", "truth": "a", "a": 3, "b": 0, "c": 0, "[other]": 2} and got["b"]["a"] == 1 and got["c"]["c"] == 4
    given = {r.truth: r.asDict() for r in V.confusion_matrix_observed(counts, [" A", "d."]).collect()}
    assert given == {"a": {"model": "m", "truth": "a", "a": 3, "d": 0, "[other]": 2}, "d": {"model": "m", "truth": "d", "a": 0, "d": 0, "[other]": 0},
                     "[other]": {"model": "m", "truth": "[other]", "a": 1, "d": 0, "[other]": 4}}
    with pytest.raises(ValueError, match="more than 2"):
        V.confusion_matrix_observed(counts, max_classes=2)
    assert V.confusion_matrix_observed(counts.where("false")).collect() == []


def test_missing_summary_is_sorted_and_takes_columns(spark):
    df = spark.createDataFrame([(1, None, None), (2, "x", None)], "a bigint, b string, c string")
    assert [tuple(r) for r in P.missing_summary(df).collect()] == [("c", 2, 100.0), ("b", 1, 50.0), ("a", 0, 0.0)]
    assert [r["column"] for r in P.missing_summary(df, ["a", "b"]).collect()] == ["b", "a"]
    with pytest.raises(ValueError):
        P.missing_summary(df, ["z"])


def test_sketches_merge_within_their_error(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("source", F.length("text").alias("n"), "text", "doc_id")
    stats = P.length_stats_of(P.length_sketches(df, "n", ["source"])).first()
    values = sorted(r.n for r in df.select("n").where("n is not null").collect())
    assert stats["count"] == len(values)
    for p in P.PERCENTILES:
        v = stats[f"p{int(round(p * 100)):02d}"]
        low, high = sum(x < v for x in values) / len(values), sum(x <= v for x in values) / len(values)
        assert low - 2 * P.KLL_RANK_ERROR <= p <= high + 2 * P.KLL_RANK_ERROR
    exact = df.agg(F.count_distinct("text").alias("t"), F.count_distinct("doc_id").alias("d")).first()
    est = P.class_count_of(P.distinct_sketches(df, ["text", "doc_id"], ["source"]), ["text", "doc_id"]).first()
    assert abs(est.text_classes - exact.t) <= 4 * P.HLL_RELATIVE_ERROR * exact.t and abs(est.doc_id_classes - exact.d) <= 4 * P.HLL_RELATIVE_ERROR * exact.d
    none = df.where("false")
    assert P.length_stats_of(P.length_sketches(none, "n", ["source"])).first()["count"] == 0
    assert P.class_count_of(P.distinct_sketches(none, ["text"], ["source"]), ["text"]).first()[0] == 0


def test_training_job_saves_model_and_metrics(spark):
    rows = [(i, ("good fine nice " if i % 2 else "bad poor sad ") * 3, "yes" if i % 2 else "no") for i in range(40)]
    df = spark.createDataFrame(rows, "job_id bigint, description string, skill_name string")
    out = scratch_path(spark, "train-job")
    paths = I.training_job(df.filter("job_id < 30"), df.filter("job_id >= 30"), out, {"num_features": 64, "max_iter": 5})
    assert spark.read.parquet(paths["eval_metrics"]).first().accuracy == 1.0 and os.path.isdir(f"{out}/model/stages")
    meta = json.loads(spark.read.text(paths["metadata"]).first()[0])
    assert meta["train_rows"] == 30 and meta["eval_rows"] == 10 and meta["training_config"] == {"num_features": 64, "max_iter": 5}
    with pytest.raises(ValueError):
        I.training_job(df.where("false"), df, out)
