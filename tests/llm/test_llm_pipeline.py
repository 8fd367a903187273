"""The corpus pipeline against its operators' brute-force versions on a fixture."""

import random

from labeltext.llm import pii, sqltext
from labeltext.llm.queries import QUERIES

import __spark_entry__
import corpus_pipeline
from test_llm_operators import naive_components, naive_edits, prose


def test_stages_and_columns(spark, tmp_path):
    r = random.Random(5)
    item = prose(77, 40)
    rows = [(i, prose(i, r.randint(30, 80)), "en", f"src{i % 3}", 0) for i in range(40)]
    rows += [(50, rows[3][1], "en", "src1", 0), (51, rows[4][1] + " end", "en", "src1", 0), (52, prose(1, 20) + " " + item + " " + prose(2, 20), "en", "src0", 0)]
    rows += [(53, "write to a.b@example.org please, " + prose(999, 30), "en", "src0", 0), (54, None, "en", "src0", 0), (55, "", None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept, now = {}, docs
    for name, function in corpus_pipeline.STAGES:
        now = function(spark, now, str(tmp_path)).cache()
        kept[name] = now.collect()
        if name != "pieces":
            assert now.columns == list(corpus_pipeline.COLUMNS)
    assert {x["doc_id"] for x in kept["language"]} >= set(range(40))  # clean texts stay
    left = [(x["doc_id"], x["text"]) for x in kept["language"]]
    assert sorted(x["doc_id"] for x in kept["near_duplicates"]) == sorted(c[0] for c in naive_components(left, 5, 80) if c[3])
    clean = [x for x in kept["near_duplicates"] if not x["text"] or naive_edits(item, x["text"]) > int(0.1 * len(item))]
    assert sorted(x["doc_id"] for x in kept["decontamination"]) == sorted(x["doc_id"] for x in clean)
    masked = {x["doc_id"]: x["text"] for x in kept["personal_data"]}
    assert masked[53].startswith("write to <EMAIL> please") and masked == {x["doc_id"]: pii.mask_text(x["text"], pii.fitted_weights()) for x in kept["decontamination"]}
    assert all(x["round_trip"] for x in kept["pieces"]) and {x["doc_id"] for x in kept["pieces"]} == set(masked)
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(repr, whole)) == sorted(map(repr, kept["pieces"]))


def test_edge_rows_pass_every_stage(spark, tmp_path):
    """Null ids and texts, repeated rows, a very long text, extra columns, and an empty table."""
    long = prose(500, 20_000)
    rows = [(1, prose(1, 60), "en", "a", 5), (1, prose(1, 60), "en", "a", 5), (None, prose(2, 60), "en", None, None), (None, prose(2, 60), "en", None, None), (2, None, None, None, None),
            (2, None, None, None, None), (3, "", "xx", "", 0), (4, long, "en", "b", len(long)), (None, None, "en", "a", 1), (5, prose(1, 60) + " Ünd", "en", "a", 1)]
    fields = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], fields + ", set_name string, s int").repartition(3)
    empty = docs.where("false")
    for name, function in corpus_pipeline.STAGES:
        docs, empty = function(spark, docs, str(tmp_path)).cache(), function(spark, empty, str(tmp_path))
        assert empty.collect() == [] and empty.columns == docs.columns
        if name != "pieces":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        texts = [r["text"] for r in docs.collect()] if name != "pieces" else []
        if name == "language":
            assert len(texts) == len(rows)
        elif name in ("near_duplicates", "decontamination"):  # one of each copy; rows without words all stay
            assert sorted((t or "")[:9] for t in texts) == sorted([prose(1, 60)[:9], prose(2, 60)[:9], long[:9], "", "", "", ""])
        elif name == "personal_data":
            assert long in texts and texts.count(None) == 3


def test_registered():
    names = __spark_entry__.queries()
    assert set(QUERIES) | {"pipeline"} <= set(names)
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert set(sqltext.ORACLE) <= set(QUERIES)


def test_near_duplicate_sql(spark, duck):
    rows = QUERIES["op4_superminhash_dedup"](spark, "/root/testdata/sf0.001")
    got = rows.select(sorted(rows.columns)).collect()
    want = duck.execute(sqltext.ORACLE["op4_superminhash_dedup"]).df()
    assert sorted(map(tuple, got)) == sorted(want[sorted(want.columns)].itertuples(index=False, name=None))
