"""The registered queries of this package: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labeltext.llm import bytecnn, decontaminate, domcrf, hosttrust, langid, lexical, neardup, orderminhash, pieces, pii, repair, slots, warc
from labeltext.llm.staging import shared_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rules of the url query: verdict, host, path prefix.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op1_host_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosttrust.judge_urls(_table(spark, sf_dir, "pages"), RULES).drop("url")


def op2_semi_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op3_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = slots.assign(_table(spark, sf_dir, "documents"), shards=16)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("position").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version",
    )


def op4_superminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = orderminhash.fingerprints(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


LANGUAGES = ("en", "fr", "de", "es")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents: the row's declared language and its source, as the host, join
    the text; the text model comes from a bounded sample of labelled rows."""
    docs = _table(spark, sf_dir, "documents")
    out = langid.identify(docs.select("doc_id", "text", "lang", "source"), langid.fit(docs, LANGUAGES), LANGUAGES, text=F.col("text"), declared=F.col("lang"), host=F.col("source"))
    return out.select("doc_id", "source", "language", "confidence")


def language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator over raw pages, with all its evidence: the markup's lang
    attribute, the address's ending and its host join the text."""
    model = langid.fit(_table(spark, sf_dir, "documents"), LANGUAGES)
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = langid.identify(
        pages, model, LANGUAGES, text=langid.visible_text(F.col("html")), declared=langid.markup_language(F.col("html")), host=hosttrust.host_of(F.col("url"))
    )
    return out.select("page_id", "url", "language", "confidence")


def op7_gumbel_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two segmentations per document: the piece ids, their digest and all scores."""
    out = pieces.encode(_table(spark, sf_dir, "documents"), k=2, packed=True)
    return out.select("doc_id", "rank", "n_pieces", pieces.digest("packed", packed=True).alias("pieces_sha256"), "log_prob", "log_inclusion", "round_trip", "perturbed", "pieces")


def op8_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_dom_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domcrf.extract(_table(spark, sf_dir, "pages"))


def op10_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return bytecnn.score(docs, bytecnn.fit(docs, _table(spark, sf_dir, "labels")))


def op11_mask_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=50)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with planted faults, repaired; the repaired texts go into a digest."""
    conversations = _table(spark, sf_dir, "conversations")
    done = repair.repair(repair.damage(conversations))
    digest = repair.digests(done.rows).withColumnRenamed("conv_id", "digest_of")
    every = conversations.select(F.col("conv_id").alias("id")).distinct()
    out = every.join(done.summary, F.col("id").eqNullSafe(F.col("conv_id")), "left").join(digest, F.col("id").eqNullSafe(F.col("digest_of")), "left")
    numbers = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("id").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op13_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages, written to the shared folder and read back."""
    path = shared_path(spark, "warc")
    warc.write(_table(spark, sf_dir, "pages"), path)
    return warc.page_records(warc.salvage(spark, path))


QUERIES = {
    f.__name__: f
    for f in (
        op1_host_trust, op2_semi_crf_pii, op3_virtual_slots, op4_superminhash_dedup, op5_order_minhash, op6_language_id, language_of_pages, op7_gumbel_pieces, op8_cgk_decontamination,
        op9_dom_crf, op10_byte_cnn, op11_mask_search, op12_conversation_repair, op13_warc_salvage,
    )
}
