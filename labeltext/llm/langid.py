"""Language identification by Bayesian evidence fusion.

The score of language ``l`` for a row is

    TEXT_WEIGHT * log P(text | l) + log P(declared | l) + log P(suffix | l) + log P(l | host)

* text: naive Bayes over hashed byte trigrams (A-Z lower-cased), fitted on a
  bounded sample of rows whose language is labelled; ``und`` is a uniform model
  that wins where a text is unlike all languages. Trigrams overlap, so
  their sum is weighted down.
* declared: the language the page's markup (or the row) claims; suffix: the
  language that the address's country ending suggests. How far either can be
  believed is counted: a table of (claimed, guessed from text alone), smoothed.
* host: how often each language was guessed on the host, smoothed towards its
  parent domain, which is smoothed towards the whole corpus. Counted over all
  rows by grouped aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from labeltext.llm import bytetext
from labeltext.llm.staging import small_side, stage

UND = "und"
BUCKETS = 1 << 16
TEXT_WEIGHT = 0.2
SAMPLE_ROWS = 2000
#: Country endings and the language they suggest; fixed values.
SUFFIXES = {
    "at": "de", "au": "en", "ch": "de", "cl": "es", "co": "es", "de": "de", "es": "es", "fr": "fr", "ie": "en",
    "mx": "es", "nz": "en", "pe": "es", "uk": "en", "us": "en",
}


def gram_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text number) of every byte trigram that lies within one text and
    holds no digit: numbers and keys speak for no language."""
    low = bytetext.lower_ascii(data).astype(np.uint32)
    if len(low) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = (low[:-2] << np.uint32(16)) | (low[1:-1] << np.uint32(8)) | low[2:]
    bucket = ((code * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    digit = (low >= ord("0")) & (low <= ord("9"))
    inside = (owner[:-2] == owner[2:]) & ~(digit[:-2] | digit[1:-1] | digit[2:])
    return bucket[inside], owner[:-2][inside]


def fit(docs: DataFrame, languages: Sequence[str], id_col: str = "doc_id", label_col: str = "lang", rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Log-probabilities (BUCKETS x languages + und) from at most ``rows``
    labelled rows, those with the smallest hash of their id; counted in Spark,
    at most BUCKETS sums per language come back. Languages without a
    sampled row keep a uniform model."""
    bytetext.bounded_batches(docs.sparkSession)
    languages = list(languages)
    known = docs.where(F.col(label_col).isin(languages) & F.col(id_col).isNotNull()).select(id_col)
    chosen = stage(known.orderBy(F.xxhash64(id_col), id_col).limit(rows).distinct(), "langid-sample")
    sample = docs.join(F.broadcast(chosen), id_col, "left_semi").where(F.col(label_col).isin(languages)).select(F.col(label_col).alias("label"), F.col("text").cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BUCKETS, len(languages)), np.int64)
        for batch in bytetext.released(batches):
            data, offsets = bytetext.buffers(batch.column("text"))
            which = np.array([languages.index(x) for x in batch.column("label").to_pylist()], np.int64)
            for a, b in bytetext.slices(offsets):
                bucket, owner = gram_buckets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                np.add.at(total, (bucket, which[a + owner]), 1)
        at, lang = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(at, pa.int32()), pa.array(total[at, lang])], ["language", "bucket", "n"])

    counts = np.full((BUCKETS, len(languages)), 0.5)
    for r in sample.mapInArrow(count, "language int, bucket int, n long").groupBy("language", "bucket").agg(F.sum("n").alias("n")).collect():
        counts[r["bucket"], r["language"]] += r["n"]
    model = np.log(counts / counts.sum(axis=0))
    return np.hstack([model, np.full((BUCKETS, 1), -np.log(BUCKETS))]).astype(np.float32)


def text_scores(model: np.ndarray, column: pa.Array) -> np.ndarray:
    """Sum of the trigrams' log-probabilities (texts x models); empty texts: 0."""
    data, offsets = bytetext.buffers(column)
    out = np.zeros((len(offsets) - 1, model.shape[1]))
    for a, b in bytetext.slices(offsets):
        bucket, owner = gram_buckets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        if len(bucket):
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            out[a + owner[first]] = np.add.reduceat(model[bucket], first, axis=0, dtype=np.float64)
    return out


def _scorer(model_rows, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_rows.value
        for batch in bytetext.released(batches):
            scores = text_scores(model, batch.column(text_col))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(scores) + 1, dtype=np.int32) * model.shape[1]), pa.array(scores.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, flat], [*batch.schema.names, "li_text"])

    return run


def _claims(column: F.Column, languages: list[str]) -> F.Column:
    """The language a tag such as ``de-AT`` claims, ``other``, or ``none``."""
    tag = F.lower(F.regexp_extract(F.coalesce(column.cast("string"), F.lit("")), r"^\s*([A-Za-z]*)", 1))
    return F.when(tag == "", "none").when(tag.isin(languages), tag).otherwise("other")


def _suffix(host: F.Column, languages: list[str]) -> F.Column:
    ending = F.lower(F.substring_index(host, ".", -1))
    out = F.lit("none")
    for lang in languages:
        out = F.when(ending.isin([k for k, v in SUFFIXES.items() if v == lang] or [""]) & host.contains("."), lang).otherwise(out)
    return out


def identify(rows: DataFrame, model: np.ndarray, languages: Sequence[str], text: F.Column, declared: F.Column | None = None, host: F.Column | None = None, kappa: float = 20.0) -> DataFrame:
    """``rows`` with ``language`` and ``confidence`` (the posterior of it)
    added; existing columns of these names are replaced, all others
    kept, whatever their names.

    A null or empty text gives no text evidence: declaration, suffix and host
    decide. A null declaration or host counts as one that says nothing. Repeated
    rows are judged alike. Ties go to the earlier language, ``und`` last.
    An empty table gives no rows.

    The text is scored twice (once for the counts, once for the result) rather
    than stored. Host priors have one row per host: broadcast while few, else
    joined by a shuffle.
    """
    spark: SparkSession = rows.sparkSession
    bytetext.bounded_batches(spark)
    languages = list(languages)
    names = [*languages, UND]
    host = F.lower(F.coalesce(host.cast("string"), F.lit(""))) if host is not None else F.lit("")
    declared = declared if declared is not None else F.lit(None).cast("string")
    kept = [c for c in rows.columns if c not in ("language", "confidence")]
    inputs = rows.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("li_row"), text.cast("string").alias("li_source"), _claims(declared, languages).alias("li_declared"), host.alias("li_host"), _suffix(host, languages).alias("li_suffix")
    )
    shared = spark.sparkContext.broadcast(model)  # BUCKETS x languages floats

    def scored(df: DataFrame) -> DataFrame:
        schema = StructType([*df.schema.fields, StructField("li_text", ArrayType(DoubleType()))])
        return df.mapInArrow(_scorer(shared, "li_source"), schema).withColumn(
            "li_text", F.transform("li_text", lambda x: x * TEXT_WEIGHT)
        )

    domain = F.when(F.col("li_host").rlike(r"\..*\."), F.regexp_extract("li_host", r"([^.]+\.[^.]+)$", 1)).otherwise(F.col("li_host"))
    guess = F.when(F.array_max("li_text") > F.array_min("li_text"), F.array_position("li_text", F.array_max("li_text")).cast("int") - 1)
    seen = scored(inputs.select("li_source", "li_declared", "li_host", "li_suffix")).select("li_declared", "li_suffix", "li_host", domain.alias("li_domain"), guess.alias("li_guess"))
    seen = stage(seen.where("li_guess is not null").groupBy("li_declared", "li_suffix", "li_host", "li_domain", "li_guess").count(), "langid-seen")

    def claim_table(column: str) -> dict[str, list[float]]:
        """log P(claim | language), of the few claims that are told apart."""
        claims = ["none", "other", *languages]
        n = {(r[0], r[1]): r[2] for r in seen.groupBy(column, "li_guess").agg(F.sum("count")).collect()}
        total = [sum(n.get((c, k), 0) for c in claims) for k in range(len(names))]
        return {c: [float(np.log((n.get((c, k), 0) + 1.0) / (total[k] + len(claims)))) for k in range(len(names))] for c in claims}

    def claim_column(column: str) -> F.Column:
        table = claim_table(column)
        out = F.array(*[F.lit(x) for x in table["none"]])
        for claim, logs in table.items():
            out = F.when(F.col(column) == claim, F.array(*[F.lit(x) for x in logs])).otherwise(out)
        return out

    per = {r[0]: r[1] for r in seen.groupBy("li_guess").agg(F.sum("count")).collect()}
    whole = sum(per.values()) + len(names)
    corpus = [(per.get(k, 0) + 1.0) / whole for k in range(len(names))]
    tally = [F.sum(F.when(F.col("li_guess") == k, F.col("count")).otherwise(0)).alias(f"n{k}") for k in range(len(names))]
    of_domain = seen.groupBy("li_domain").agg(*[t.alias(f"d{k}") for k, t in enumerate(tally)])
    of_host = seen.groupBy("li_host", "li_domain").agg(*tally)
    d_all, h_all = sum(F.col(f"d{k}") for k in range(len(names))), sum(F.col(f"n{k}") for k in range(len(names)))
    parent = [(F.col(f"d{k}") + kappa * corpus[k]) / (d_all + kappa) for k in range(len(names))]
    prior = F.array(*[F.log((F.col(f"n{k}") + kappa * parent[k]) / (h_all + kappa)) for k in range(len(names))])
    priors = stage(of_host.join(of_domain, "li_domain").select("li_host", prior.alias("li_prior")), "langid-hosts")

    by_claim, by_suffix = claim_column("li_declared"), claim_column("li_suffix")
    fused = scored(inputs).join(small_side(priors), "li_host", "left")
    none = F.array(*[F.lit(float(np.log(c))) for c in corpus])
    at = [F.col("li_text")[k] + by_claim[k] + by_suffix[k] + F.coalesce("li_prior", none)[k] for k in range(len(names))]
    fused = fused.withColumn("li_all", F.array(*at)).withColumn("li_top", F.array_max("li_all"))
    mass = F.aggregate("li_all", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("li_top")))
    best = F.element_at(F.array(*[F.lit(x) for x in names]), F.array_position("li_all", F.col("li_top")).cast("int"))
    return fused.select(*[F.col("li_row")[c].alias(c) for c in kept], best.alias("language"), F.round(1 / mass, 9).alias("confidence"))


def visible_text(html: F.Column) -> F.Column:
    """The text of a page as far as its language needs it: no scripts, styles,
    comments, tags or references, one space for each run of white space (the gaps
    that markup leaves speak for no language)."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>|&[#a-z0-9]+;?", " ")
    return F.regexp_replace(text, r"\s+", " ")


def markup_language(html: F.Column) -> F.Column:
    """The ``lang`` attribute of the page's ``html`` tag, or null."""
    found = F.regexp_extract(html, r"""(?is)<html\b[^>]*?\slang\s*=\s*["']?\s*([A-Za-z\-]+)""", 1)
    return F.when(found != "", found)
