"""Declared schemas and the missing-value tokens applied at raw ingest."""

from __future__ import annotations

from pyspark.sql.types import LongType, StringType, StructField, StructType

# The posting columns the pipeline works on.
POSTING_COLUMNS = [
    "job_id",
    "company_name",
    "title",
    "description",
    "location",
    "formatted_work_type",
    "formatted_experience_level",
]
TEXT_COLUMNS = POSTING_COLUMNS[1:]
OPTIONAL_COLUMNS = ["company_name", "location", "formatted_work_type", "formatted_experience_level"]
NOT_SPECIFIED = "Not specified"

# Cell texts a default pandas CSV read turns into missing.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

POSTINGS_SCHEMA = StructType(
    [StructField("job_id", LongType())]
    + [StructField(c, StringType()) for c in TEXT_COLUMNS]
)
BRIDGE_SCHEMA = StructType([StructField("job_id", LongType()), StructField("skill_abr", StringType())])
DIMENSION_SCHEMA = StructType([StructField("skill_abr", StringType()), StructField("skill_name", StringType())])
