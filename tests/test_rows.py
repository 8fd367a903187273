"""Dedup, minimum words, split, sample, label folding (FIXTURES edge rows)."""

import pytest
from pyspark.sql import functions as F

from labeltext.operators import clean as C
from labeltext.operators import labels as L
from labeltext.operators import rank as R
from labeltext.sources.schema import POSTING_COLUMNS


def postings(spark, rows):
    full = [(i, "c", t, d, "l", None, None) for i, t, d in rows]
    return spark.createDataFrame(full, "job_id bigint, company_name string, title string, description string, "
                                       "location string, formatted_work_type string, formatted_experience_level string")


def words(n):
    return " ".join(["w"] * n)


def test_dedup_keeps_smallest_id_and_ignores_markup(spark):
    df = postings(spark, [(7, "T", words(60)), (3, "T", words(60)), (9, "<b>T</b>", "<p>" + words(60) + "</p>")])
    out = C.preprocess_postings(df, 50)
    assert [r.job_id for r in out.collect()] == [3]
    assert out.columns == POSTING_COLUMNS + ["description_character_count", "description_word_count"]
    assert out.first().formatted_work_type == "Not specified"


def test_min_words_inclusive(spark):
    df = postings(spark, [(1, "a", words(49)), (2, "b", words(50))])
    assert [r.job_id for r in C.preprocess_postings(df, 50).collect()] == [2]


def test_report_and_funnel(spark):
    df = postings(spark, [(1, "a", words(60)), (2, "a", words(60)), (3, None, "x"), (4, " ", words(60)),
                          (5, "b", words(3))])
    rep = {r.metric: r.value for r in C.cleaning_report(df, 50).collect()}
    assert rep["original_rows"] == 5 and rep["final_rows"] == 1 and rep["removed_rows"] == 4
    assert rep["retention_rate_percentage"] == 20.0 and rep["remaining_duplicate_jobs"] == 0
    steps = {r.step: r.rows_removed for r in C.drop_funnel(df, 50).collect()}
    assert steps == {"missing": 1, "blank_after_clean": 1, "duplicate": 1, "short": 1}


@pytest.mark.parametrize("n,sizes", [(10, (8, 1, 1)), (1, (0, 0, 1)), (0, (0, 0, 0)), (7, (5, 1, 1))])
def test_split_sizes(spark, n, sizes):
    df = spark.createDataFrame([(i, "lab") for i in range(n)], "job_id bigint, skill_name string")
    got = {r.split: r.rows for r in R.split_sizes(R.split_dataset(df)).collect()}
    assert (got["train"], got["validation"], got["test"]) == sizes


def test_split_is_partition_and_repeatable(spark):
    df = spark.range(1000).select(F.col("id").alias("job_id"), F.lit("x").alias("skill_name"))
    a = R.split_dataset(df, random_seed=7)
    b = R.split_dataset(df.repartition(13), random_seed=7)
    assert a.count() == 1000 and a.select("job_id").distinct().count() == 1000
    assert sorted(a.collect()) == sorted(b.collect())
    ranks = R.rank_table(df, "job_id", 7).select("rank").collect()
    assert sorted(r.rank for r in ranks) == list(range(1, 1001))


@pytest.mark.parametrize("digits", [1, 2, 4])
def test_cut_by_rank_equals_full_rank(spark, digits):
    """Only straddling buckets are ranked; the labels must equal those of a
    full rank, whatever the bucket size (1 digit: 16 buckets of ~60 rows)."""
    df = spark.range(997).select(F.col("id").alias("job_id"), F.lit("x").alias("skill_name"))
    cut = R.split_dataset(df, random_seed=3, bucket_digits=digits).select("job_id", "split")
    full = R.split_dataset(df, random_seed=3, keep_rank=True, bucket_digits=digits).select("job_id", "split")
    assert sorted(cut.collect()) == sorted(full.collect())
    ranked = R.global_rank(df, "job_id", 3)
    for n in (1, 59, 60, 61, 500, 997):
        want = {r.job_id for r in ranked.filter(F.col("rank") <= n).collect()}
        got = {r.job_id for r in R.sample_exact(df, n, 3, bucket_digits=digits).collect()}
        assert got == want, n


def test_sample_exact(spark):
    df = spark.range(50).select(F.col("id").alias("job_id"))
    assert R.sample_exact(df, 10).count() == 10
    assert R.sample_exact(df, 500).count() == 50
    assert R.sample_exact(df, None).count() == 50
    with pytest.raises(ValueError):
        R.sample_exact(df, 0)


def test_fold_labels(spark):
    mapped = spark.createDataFrame([(1, "b"), (1, " a "), (1, "b"), (1, ""), (2, ""), (2, " "), (None, "z")],
                                   "job_id bigint, skill_name string")
    got = {r.job_id: r.skill_name for r in L.fold_labels(mapped).collect()}
    assert got == {1: "a, b", 2: ""}


def test_only_unmapped_codes_give_no_row(spark):
    bridge = spark.createDataFrame([(1, "X"), (2, "Q1"), (3, None)], "job_id bigint, skill_abr string")
    dim = spark.createDataFrame([("Q1", "Good"), (None, "NullCode")], "skill_abr string, skill_name string")
    folded = {r.job_id: r.skill_name for r in L.fold_labels(L.map_labels(bridge, dim)).collect()}
    assert folded == {2: "Good", 3: "NullCode"}
    assert {r.skill_abr: r.rows for r in L.unmapped_codes(bridge, dim).collect()} == {"X": 1}


def test_coverage_empty_is_zero(spark):
    df = spark.createDataFrame([], "job_id bigint, skill_name string")
    assert L.label_coverage(df).first().label_coverage == 0.0


def test_sized_broadcast_checks_rows_and_bytes(spark):
    from labeltext.operators.common import sized_broadcast

    def hinted(df):
        return "broadcast" in df._jdf.queryExecution().analyzed().toString().lower()

    small = spark.createDataFrame([("a", "x" * 10)] * 5, "k string, v string")
    assert hinted(sized_broadcast(small, max_rows=5))
    assert not hinted(sized_broadcast(small, max_rows=4))
    assert not hinted(sized_broadcast(small, max_rows=10, max_bytes=40))
    assert hinted(sized_broadcast(small, max_rows=10, max_bytes=60))


def test_report_self_checks_hold_on_the_cleaned_table(spark):
    """The report gives remaining duplicates and missing title/description as
    0 by construction; recompute them on the real cleaned output."""
    from labeltext.sources import tables as S

    postings = S.postings_from_documents(spark, "/root/testdata/sf0.01")
    cleaned = C.preprocess_postings(postings)
    got = cleaned.agg(
        (F.count("*") - F.count_distinct(C.pair_key("title", "description"))).alias("dups"),
        F.count_if(F.col("title").isNull()).alias("t"), F.count_if(F.col("description").isNull()).alias("d"),
        F.count("*").alias("n")).first()
    rep = {r.metric: r.value for r in C.cleaning_report(postings).collect()}
    assert (got.dups, got.t, got.d) == (0, 0, 0)
    assert rep["remaining_duplicate_jobs"] == 0 and rep["missing_titles"] == 0
    assert rep["final_rows"] == got.n


def test_dedup_hot_group_is_pre_aggregated(spark):
    """A third of all rows share one (title, description): the winner is the
    smallest id, and the plan aggregates partially before the shuffle."""
    n = 3000
    rows = [(i, "hot", "same text") if i % 3 == 0 else (i, f"t{i}", f"d{i}") for i in range(n, 0, -1)]
    df = spark.createDataFrame(rows, "job_id bigint, title string, description string").repartition(6)
    out = C.dedup_first(df, ["title", "description"])
    got = {r.job_id for r in out.filter(F.col("title") == "hot").collect()}
    assert got == {3} and out.count() == n - n // 3 + 1
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_min(" in plan


def test_no_row_is_lost_without_an_id(spark):
    from labeltext.operators import rank as R

    rows = [(None if i % 4 == 0 else i % 5, f"skill{i % 3}", i) for i in range(40)]
    results = []
    for parts in (1, 2, 3, 5, 7):
        df = spark.createDataFrame(rows, "job_id long, skill_name string, x int").repartition(parts)
        cut = R.split_dataset(df, bucket_digits=1).collect()
        assert len(cut) == 40 and len({r["x"] for r in cut}) == 40
        assert sorted(r["rank"] for r in R.global_rank(df).collect()) == list(range(1, 41))
        assert R.sample_exact(df, 20).count() == 20
        results.append(sorted((r["x"], r["split"]) for r in cut))
    assert all(r == results[0] for r in results)


def test_dedup_keeps_rows_without_an_id_and_settles_ties(spark):
    from labeltext.operators import clean as C

    rows = [(None, "a", "z"), (None, "b", "y"), (3, "c", "x"), (None, "c", "w"), (7, "t", "q"), (7, "t", "p")]
    want = [(None, "a", "z"), (None, "b", "y"), (3, "c", "x"), (7, "t", "p")]
    for parts in (1, 2, 3, 5, 6):
        df = spark.createDataFrame(rows, "job_id long, title string, company_name string").repartition(parts)
        assert sorted(map(tuple, C.dedup_first(df, ["title"]).collect()), key=lambda r: r[1]) == want


def test_report_checks_read_the_cleaned_table(spark):
    from labeltext.operators import clean as C
    from labeltext.sources.schema import POSTINGS_SCHEMA

    post = spark.createDataFrame([(1, "c", "t", "one two three", "l", "w", "e")], POSTINGS_SCHEMA)
    bad = spark.createDataFrame([("t", "d"), ("t", "d"), (None, "e")], "title string, description string")
    got = {r["metric"]: r["value"] for r in C.cleaning_report(post, 1, cleaned=bad).collect()}
    assert (got["remaining_duplicate_jobs"], got["missing_titles"], got["missing_descriptions"]) == (1, 1, 0)


def test_given_classes_are_normalised_and_zero_filled(spark):
    from labeltext.operators import evaluate as V

    counts = spark.createDataFrame([("m", "a", "b", 2)], "model string, truth string, prediction string, n long")
    got = sorted(map(tuple, V.confusion_matrix_wide(counts, ["A", " b"]).collect()))
    assert got == [("m", "a", 0, 2), ("m", "b", 0, 0)]


def test_null_message_content_is_rendered_empty(spark):
    from labeltext.functions.prompts import DEFAULT_TEMPLATE

    df = spark.createDataFrame([([("user", "hi"), ("assistant", None)],)], "m array<struct<role:string,content:string>>")
    assert df.select(DEFAULT_TEMPLATE.render("m")).first()[0] == "<|user|>\nhi<|end|>\n<|assistant|>\n<|end|>\n"


def test_csv_hand_off_keeps_quotes_and_commas(spark, tmp_path):
    from labeltext.plans import preprocessing as PP
    from labeltext.sources.schema import BRIDGE_SCHEMA, DIMENSION_SCHEMA, POSTINGS_SCHEMA

    rows = [(i, "c", f'He said "hi", ok {i}', f'a, "b"\nc {i}', None, "w", "e") for i in range(12)]
    post = spark.createDataFrame(rows, POSTINGS_SCHEMA)
    bridge = spark.createDataFrame([(i, "S") for i in range(12)], BRIDGE_SCHEMA)
    dim = spark.createDataFrame([("S", "Sales")], DIMENSION_SCHEMA)
    out = {}
    for fmt in ("parquet", "csv"):
        cfg = PP.PreprocessingConfig(min_description_words=1, fmt=fmt)
        got = PP.run_preprocessing_pipeline(spark, post, bridge, dim, str(tmp_path / fmt), cfg)
        out[fmt] = got["summary"]
        from labeltext.sources.files import read_csv
        path = got["paths"]["cleaned_postings"]
        table = spark.read.parquet(path) if fmt == "parquet" else read_csv(spark, path, POSTINGS_SCHEMA)
        out[fmt + "_rows"] = sorted(map(tuple, table.select(POSTINGS_SCHEMA.names).collect()))
    assert out["parquet"] == out["csv"] and out["parquet_rows"] == out["csv_rows"]
