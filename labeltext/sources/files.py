"""File sources: SRC1 (CSV ingest), SRC2 (files read by their content), SRC3
(rejected rows with their causes), SRC4 (file search by candidate names)."""

from __future__ import annotations

import csv
import io
import zlib
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.validate import require_columns
from .schema import NA_TOKENS


def apply_na_tokens(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Cells equal to one of ``NA_TOKENS`` become NULL (string columns only),
    as a default pandas CSV read does."""
    cols = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    return df.select(*[
        F.when(F.col(c).isin(NA_TOKENS), F.lit(None).cast("string")).otherwise(F.col(c)).alias(c)
        if c in cols else F.col(c) for c in df.columns])


def _csv_reader(spark: SparkSession) -> DataFrameReader:
    return (spark.read.option("header", True).option("multiLine", True).option("inferSchema", False)
            .option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE"))


def read_csv(spark: SparkSession, path: str | list[str], schema: StructType | str | None = None,
             na_tokens: bool = True) -> DataFrame:
    """SRC1: header CSV with quoted newlines and doubled quotes.

    The columns of a declared ``schema`` are taken by their names in the header,
    in whatever order they stand there; further columns are ignored and a
    missing one is an error. All are read as text, NA tokens applied, then cast
    (so 'NA' in a number column is NULL, not a parse error). Files of one call
    share the header of the first. Quoted line breaks make a file one task:
    read large raw files once, into Parquet.
    """
    df = _csv_reader(spark).csv(path)
    if schema is None:
        return apply_na_tokens(df) if na_tokens else df
    st = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    require_columns(df, st.names, f"the CSV at {path}")
    df = df.select(*[F.col(f"`{n}`") for n in st.names])
    if na_tokens:
        df = apply_na_tokens(df)
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in st.fields])


# --- SRC2: the format is what the first bytes say -----------------------------

# Leading bytes of file formats.
MAGIC = {b"PK\x03\x04": "xlsx", b"\xd0\xcf\x11\xe0": "xls", b"PAR1": "parquet", b"\x1f\x8b": "gzip"}
TEXT_SUFFIXES = (".csv", ".txt", ".xls", ".xlsx", ".csv.gz", ".txt.gz")
HEAD_BYTES = 8192
HEAD_THREADS = 16

FILES = "path string, length long, format string, status string, reason string, header array<string>"


def _heads(spark: SparkSession, paths: list[str], n: int) -> list[bytes]:
    """The first ``n`` bytes of each file, by range reads through the Hadoop file
    system that Spark itself uses, whatever the store."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def head(path: str) -> bytes:
        where = jvm.org.apache.hadoop.fs.Path(path)
        stream = where.getFileSystem(conf).open(where)
        try:
            return bytes(stream.readNBytes(n))
        finally:
            stream.close()

    with ThreadPool(HEAD_THREADS) as pool:
        return pool.map(head, paths)


def _judge(path: str, head: bytes) -> tuple[str, str, str | None, list[str] | None]:
    """(format, status, reason, CSV header) of a file."""
    form = next((f for m, f in MAGIC.items() if head.startswith(m)), "csv")
    if form == "parquet":
        return form, "read", None, None
    if not path.lower().endswith(TEXT_SUFFIXES):
        return "unsupported", "rejected", "neither a CSV, workbook nor Parquet file by its suffix and first bytes", None
    if form in ("xls", "xlsx"):
        return form, "rejected", f"as CSV: binary content; as a workbook: {form} is not decoded", None
    if form == "gzip":
        if not path.lower().endswith(".gz"):
            return form, "rejected", "as CSV: gzip content without the suffix .gz; as a workbook: not one", None
        try:
            head = zlib.decompressobj(31).decompress(head)
        except zlib.error as e:
            return form, "rejected", f"as CSV: {e}; as a workbook: not one", None
    if not head.strip():
        return "csv", "rejected", "as CSV: no header; as a workbook: not one", None
    if b"\0" in head:
        return "binary", "rejected", "as CSV: binary content; as a workbook: not one", None
    return "csv", "read", None, next(csv.reader(io.StringIO(head.decode("utf-8-sig", "replace"), newline="")))


def _listed(spark: SparkSession, path: str, glob: str | None) -> list[tuple]:
    """FILES rows, by path. The driver holds a row per file, as Spark's own listing does."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    found = sorted((r["path"], r["length"]) for r in reader.load(path).select("path", "length").collect())
    heads = _heads(spark, [p for p, _ in found], HEAD_BYTES)
    return [(p, n, *_judge(p, h)) for (p, n), h in zip(found, heads)]


def sniff_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """SRC2: one row per file under ``path`` with its format by content, whether it
    can be read, and if not why, both as CSV and as a workbook. Only the first
    ``HEAD_BYTES`` of a file are read. Spark does not list files of no bytes."""
    return spark.createDataFrame(_listed(spark, path, glob), FILES).drop("header")


def read_by_content(spark: SparkSession, path: str, schema: StructType | str, glob: str | None = None) -> tuple[DataFrame, DataFrame]:
    """SRC2: (rows, files): the rows of all readable files under ``path`` in the
    columns of ``schema``, and :func:`sniff_files`' table with the rejected ones.

    CSV text counts whatever the suffix (``.xls`` too), also gzip text named ``.gz``;
    Parquet files count by their first bytes. Files are read by one scan per
    distinct header, so their columns may stand in any order. NA tokens are applied
    to all. If no file can be read, the error names every file's causes.
    """
    st = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    listed = _listed(spark, path, glob)
    if not any(r[3] == "read" for r in listed):
        raise ValueError(f"no readable file under {path}: " + "; ".join(f"{r[0]}: {r[4]}" for r in listed))
    groups: dict[tuple, list[str]] = {}
    for p, _, form, status, _, header in listed:
        if status == "read":
            groups.setdefault((form, tuple(header or ())), []).append(p)
    frames = []
    for (form, _), paths in groups.items():
        if form == "csv":
            frames.append(read_csv(spark, paths, st))
        else:
            df = spark.read.parquet(*paths)
            require_columns(df, st.names, f"the Parquet files at {path}")
            df = apply_na_tokens(df.select(*[F.col(f"`{n}`") for n in st.names]))
            frames.append(df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in st.fields]))
    rows = frames[0]
    for more in frames[1:]:
        rows = rows.unionByName(more)
    return rows, spark.createDataFrame(listed, FILES).drop("header")


# --- SRC3: rows that do not fit ------------------------------------------------

RECORD, CAUSES = "_record", "_causes"


def read_csv_checked(spark: SparkSession, path: str | list[str], schema: StructType | str) -> DataFrame:
    """SRC3: every record of the CSV files in the columns of ``schema``, plus
    ``_causes`` (empty for a good row) and ``_record`` (the raw text of a record
    whose shape is wrong).

    Causes: ``shape`` (more or fewer fields than the header) and ``value:<column>``
    (neither an NA token nor a value of the column's type). Nothing is dropped.
    Files of one call share the header of the first.
    """
    st = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    raw = _csv_reader(spark).csv(path)
    require_columns(raw, st.names, f"the CSV at {path}")
    record = next(c for c in (RECORD, *(f"{RECORD}{k}" for k in range(len(raw.columns) + 1))) if c not in raw.columns)
    text = StructType([StructField(c, StringType()) for c in [*raw.columns, record]])
    df = _csv_reader(spark).option("columnNameOfCorruptRecord", record).schema(text).csv(path)
    cells = {f.name: F.when(~F.col(f"`{f.name}`").isin(NA_TOKENS), F.col(f"`{f.name}`")) for f in st.fields}
    causes = [F.when(F.col(record).isNotNull(), "shape")] + [
        F.when(cells[f.name].isNotNull() & cells[f.name].try_cast(f.dataType).isNull(), f"value:{f.name}")
        for f in st.fields if not isinstance(f.dataType, StringType)]
    return df.select(*[cells[f.name].try_cast(f.dataType).alias(f.name) for f in st.fields],
                     F.array_compact(F.array(*causes)).alias(CAUSES), F.col(record).alias(RECORD))


def split_rejects(checked: DataFrame, output_dir: str) -> tuple[DataFrame, DataFrame]:
    """SRC3: (good rows, rejects), written by one pass over ``read_csv_checked``'s
    rows into the folders ``verdict=good`` and ``verdict=reject`` of ``output_dir``."""
    verdict = F.when(F.size(CAUSES) == 0, "good").otherwise("reject")
    checked.withColumn("verdict", verdict).write.mode("overwrite").partitionBy("verdict").parquet(output_dir)
    # Cells of a record of the wrong shape stand in the wrong columns; its text is what counts.
    both = checked.sparkSession.read.schema(StructType([*checked.schema.fields, StructField("verdict", StringType())])).parquet(output_dir)
    good = both.where("verdict = 'good'").drop("verdict", CAUSES, RECORD)
    return good, both.where("verdict = 'reject'").drop("verdict")


def find_file(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """SRC4: files under ``root`` whose name is one of ``names``; the sorted
    first is marked ``chosen``, and ``matches`` reports how many were found."""
    pattern = "{" + ",".join(names) + "}"
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .option("pathGlobFilter", pattern).load(root).select("path"))
    first = files.select(F.min("path")).scalar()
    total = files.select(F.count("*")).scalar()
    return files.select("path", (F.col("path") == first).alias("chosen"), total.alias("matches"))
