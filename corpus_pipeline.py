"""The corpus pipeline: five operators of ``labeltext.llm`` in a row.

Each stage takes the documents that the one before it kept, and all but the last
return the columns of ``documents``:

1. ``language``: rows whose text is surely in none of the known languages go;
   the ``lang`` of the others becomes the language found.
2. ``near_duplicates``: one document of every component of near-duplicate texts
   (five-word shingles, similarity 0.8 or more) stays, the one with the smallest
   doc_id; rows without words all stay.
3. ``decontamination``: documents that hold a benchmark passage go.
4. ``personal_data``: spans of personal data are replaced by their kind.
5. ``pieces``: every text is encoded into sampled sentence pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labeltext.llm import decontaminate, langid, neardup, pieces, pii
from labeltext.llm.queries import LANGUAGES
from labeltext.llm.staging import stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text is rejected if no known language is this sure.
REJECT_AT = 0.9


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known, with it as their ``lang``. The text
    model is fitted on a bounded sample of ``docs`` labelled by ``lang``. A null or empty
    text is judged by its declaration and source, and stays unless these are surely
    foreign; repeated rows are judged alike, rows of any length whole, null
    ids like others. An empty table gives no rows."""
    model = langid.fit(docs, LANGUAGES)
    found = langid.identify(docs.select(*COLUMNS), model, LANGUAGES, text=F.col("text"), declared=F.col("lang"), host=F.col("source"))
    kept = found.where(~((F.col("language") == langid.UND) & (F.col("confidence") >= REJECT_AT)))
    return kept.withColumn("lang", F.when(F.col("language") == langid.UND, F.col("lang")).otherwise(F.col("language"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document per component of near-duplicate texts, also of copies that
    share an id or have none; documents without words all stay. An empty table
    gives no rows."""
    return neardup.one_of_each(docs.select(*COLUMNS), shingle=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark, whole texts searched. Null or
    empty texts hold none; repeated rows are judged alike, null ids like others. An empty
    benchmark drops nothing, an empty table gives no rows."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked in their whole texts; ``n_chars`` follows
    the new text and is null for a null one. Every row stays, repeated ones too; an
    empty table gives no rows."""
    return pii.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations per document, as piece ids, seeded by the row's
    key; see ``pieces.encode`` for null, empty and repeated rows. An empty table gives no rows."""
    return pieces.encode(docs, k=2)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("pieces", sentence_pieces),
]

#: SQL cannot state most stages; tests/llm hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each stage's result is written
    as Parquet to the shared folder and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
