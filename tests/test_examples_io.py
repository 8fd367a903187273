"""PRM5 encoded examples, SRC1 CSV ingest, INF1 batch prediction, the
streaming cleaner, and plan-shape checks (SURVEY section 5, items 1, 4, 5)."""

import os

import pytest
import xxhash
from pyspark.sql import functions as F

from labeltext.functions import prompts as PR
from labeltext.operators import clean as C
from labeltext.operators import examples as X
from labeltext.operators import infer as I
from labeltext.operators import rank as R
from labeltext.session import scratch_path
from labeltext.sources import files as FS
from labeltext.sources.schema import NA_TOKENS
from labeltext.streaming import cleaning as SC


def _xxh(token: str, vocab: int) -> int:
    v = xxhash.xxh64_intdigest(token.encode("utf-8"), seed=42)
    v = v - (1 << 64) if v >= 1 << 63 else v  # Spark returns a signed long
    return v % vocab


def _py_example(title, description, label, max_length, max_desc, vocab):
    t = PR.DEFAULT_TEMPLATE
    desc = " ".join(description.split()[:max_desc])
    prompt = (PR.PROMPT_HEAD + PR.PROMPT_TITLE + title.strip() + PR.PROMPT_DESCRIPTION + desc.strip()
              + PR.PROMPT_TAIL)

    def render(msgs, gen):
        body = "".join(t.open.format(role=r) + c + t.close for r, c in msgs)
        return body + (t.generation if gen else "")

    prompt_text = render([("user", prompt)], True)
    full_text = render([("user", prompt), ("assistant", label)], False)
    ids = [_xxh(tok, vocab) for tok in full_text.split()][:max_length]
    n, plen = len(ids), min(len(prompt_text.split()), max_length)
    input_ids = ids + [0] * (max_length - n)
    mask = [1] * n + [0] * (max_length - n)
    labels = [-100 if i < plen or i >= n else input_ids[i] for i in range(max_length)]
    return input_ids, mask, labels


@pytest.mark.parametrize("max_length", [8, 40, 64])
def test_encode_examples_match_python(spark, max_length):
    rows = [(1, "Data analyst", "Builds  reports\nand dashboards " * 5, "Analytics"),
            (2, "  Nurse ", "x", "Health, Care"),
            (3, "", "one two three", "A")]
    df = spark.createDataFrame(rows, "job_id bigint, title string, description string, skill_name string")
    enc = X.encode_examples(df, max_length=max_length, max_description_tokens=6, vocab_size=997)
    got = {r.job_id: (list(r.input_ids), list(r.attention_mask), list(r.labels)) for r in enc.collect()}
    for i, t, d, lab in rows:
        assert got[i] == _py_example(t, d, lab, max_length, 6, 997), i


def test_truncate_tokens_matches_split(spark):
    vals = ["a  b\tc\nd e", "", "   ", "one", None, "x " * 10]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r[0] for r in df.select(PR.truncate_tokens("v", 3)).collect()]
    want = [None if v is None else " ".join(v.split()[:3]) for v in vals]
    assert got == want


def test_csv_ingest_na_tokens_and_quotes(spark):
    path = scratch_path(spark, "csv-test")
    os.makedirs(path)
    with open(f"{path}/part.csv", "w", encoding="utf-8") as f:
        f.write('job_id,title,description\n')
        f.write('1,NA,"line one\nline ""two"""\n')
        f.write('2,None,null\n')
        f.write('3,"",plain\n')
        f.write('4,ok,#N/A\n')
    df = FS.read_csv(spark, path, "job_id BIGINT, title STRING, description STRING")
    got = {r.job_id: (r.title, r.description) for r in df.collect()}
    assert got == {1: (None, 'line one\nline "two"'), 2: (None, None), 3: (None, "plain"), 4: ("ok", None)}
    assert {"NA", "None", "null", "", "#N/A", "nan"} <= set(NA_TOKENS)


def test_batch_predict_keyed_and_batched(spark):
    seen = []

    def make():
        def pred(batch):
            seen.append(len(batch))
            return [f"Answer: {p.upper()}." for p in batch]
        return pred

    df = spark.createDataFrame([(i, f"p{i}") for i in range(25)], "job_id bigint, instruction string")
    out = I.batch_predict(df.repartition(3), make, batch_size=4)
    got = {r.job_id: r.raw_prediction for r in out.collect()}
    assert got == {i: f"Answer: P{i}." for i in range(25)}
    with pytest.raises(ValueError):
        I.batch_predict(df, make, batch_size=0)


def test_streaming_cleaner_equals_batch(spark):
    src = scratch_path(spark, "stream-src")
    sink = scratch_path(spark, "stream-sink")
    rows = [(1, "c", "T", "w " * 60, "l", None, "x"), (2, "c", "T", "w " * 60, "l", "a", None),
            (3, "c", "S", "short text", "l", "a", "b"), (4, None, "<b>U</b>", "v " * 55, None, "a", "b")]
    schema = ("job_id bigint, company_name string, title string, description string, location string, "
              "formatted_work_type string, formatted_experience_level string")
    spark.createDataFrame(rows, schema).write.parquet(src)
    q = SC.start_cleaning_stream(spark, src, spark.read.parquet(src).schema, sink,
                                 checkpoint_dir=scratch_path(spark, "stream-ckpt"), available_now=True)
    q.awaitTermination(120)
    streamed = C.finish_postings(spark.read.parquet(sink))
    batch = C.preprocess_postings(spark.read.parquet(src))
    assert sorted(streamed.collect()) == sorted(batch.collect())
    assert sorted(r.job_id for r in batch.collect()) == [1, 4]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_native_functions_have_no_python(spark):
    df = spark.range(10).select(F.col("id").alias("job_id"), F.lit("a b").alias("title"),
                                F.lit("c d").alias("description"), F.lit("x").alias("skill_name"))
    plan = _plan(X.encode_examples(df))
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    native = _plan(C.preprocess_postings(
        df.select("job_id", F.lit("co").alias("company_name"), "title", "description",
                  F.lit("l").alias("location"), F.lit(None).cast("string").alias("formatted_work_type"),
                  F.lit(None).cast("string").alias("formatted_experience_level"))))
    assert "EvalPython" not in native


def test_split_ranks_only_straddling_buckets(spark):
    df = spark.range(5000).select(F.col("id").alias("job_id"), F.lit("x").alias("skill_name"))
    plan = _plan(R.split_dataset(df))
    # no single-partition exchange carries the rows themselves: the only one is
    # over the ranges of the straddling rows, counted
    assert "Window" in plan
    lines = plan.splitlines()
    singles = [i for i, line in enumerate(lines) if "Exchange SinglePartition" in line]
    assert singles
    for i in singles:
        assert "HashAggregate" in lines[i + 1] and "_part" in lines[i + 1], lines[i:i + 2]


@pytest.mark.parametrize("parts", [1, 64])
def test_partition_invariance(spark, parts):
    from labeltext.plans.queries import REGISTRY

    sf = "/root/testdata/sf0.001"
    names = ["clean_postings", "cleaning_report", "drop_funnel", "split_dataset", "classification_report",
             "fold_labels_at_size", "length_stats"]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    base = {n: sorted(map(tuple, REGISTRY[n](spark, sf).collect())) for n in names}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for n in names:
            assert sorted(map(tuple, REGISTRY[n](spark, sf).collect())) == base[n], n
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_streaming_default_checkpoint_is_per_sink(spark):
    src = scratch_path(spark, "stream-src2")
    schema = ("job_id bigint, company_name string, title string, description string, location string, "
              "formatted_work_type string, formatted_experience_level string")
    spark.createDataFrame([(1, "c", "T", "w " * 60, "l", "a", "b")], schema).write.parquet(src)
    sinks = [scratch_path(spark, "stream-sink-a"), scratch_path(spark, "stream-sink-b")]
    for sink in sinks:
        q = SC.start_cleaning_stream(spark, src, spark.read.parquet(src).schema, sink, available_now=True)
        q.awaitTermination(120)
        assert spark.read.parquet(sink).count() == 1


def test_global_rank_reads_its_written_ranges(spark):
    df = spark.range(2000).select(F.col("id").alias("job_id"), F.lit("x").alias("payload"))
    ranked = R.global_rank(df, "job_id", 5)
    plan = _plan(ranked)
    # the rows were exchanged once, by range, before they were written; the
    # offsets of the ranges are broadcast and there is no join back on the id
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "rangepartitioning" not in plan
    assert sorted(r.rank for r in ranked.collect()) == list(range(1, 2001))


def test_equal_rows_without_an_id_spread_over_ranges(spark):
    """A third of the rows has no id and equal columns: no range holds more than
    twice the median, and the ranks are 1..N."""
    from labeltext.session import stage_table

    df = spark.range(30_000).select(F.when(F.col("id") % 3 != 0, F.col("id")).alias("job_id"), F.lit("x").alias("source"))
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        staged = []
        R.stage_table = lambda d, name: staged.append(stage_table(d, name)) or staged[-1]
        ranked = R.global_rank(df, "job_id", 5)
        sizes = sorted(r["count"] for r in staged[0].groupBy(R._PART).count().collect())
        assert len(sizes) == 8 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
        assert ranked.agg(F.count_distinct("rank"), F.min("rank"), F.max("rank")).first() == (30_000, 1, 30_000)
        split = R.split_dataset(df.withColumn("skill_name", F.lit("a")))
        assert {r["split"]: r["count"] for r in split.groupBy("split").count().collect()} == {"train": 24_000, "validation": 3_000, "test": 3_000}
    finally:
        R.stage_table = stage_table
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_approximate_samples_are_nested_repeatable_and_near_their_share(spark):
    df = spark.range(20_000).select(F.col("id").alias("job_id"))
    small = {r[0] for r in R.sample_approximate(df, 0.1, 7).collect()}
    again = {r[0] for r in R.sample_approximate(df.repartition(13), 0.1, 7).collect()}
    large = {r[0] for r in R.sample_approximate(df, 0.3, 7).collect()}
    assert small == again and small < large and R.sample_approximate(df, 1).count() == 20_000
    for got, share in ((small, 0.1), (large, 0.3)):
        assert abs(len(got) - 20_000 * share) <= 4 * (20_000 * share * (1 - share)) ** 0.5
    for share in (0, 1.1):
        with pytest.raises(ValueError):
            R.sample_approximate(df, share)
