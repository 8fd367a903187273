"""WARC archives: written through Spark, read back by a salvage reader.

Writing. Every page becomes a record, its payload the HTML bytes behind an HTTP
header; of pages with equal payloads of some size, one is a ``response`` and the
others ``revisit`` it without repeating the payload. Tasks build blocks of
whole records, each record its own gzip member, and Spark's text writer puts
the blocks one after the other into files and commits them. That writer ends every value
with a separator, so the last byte of a block is left to it: the top byte of
a member's length (0, as members hold less than 16 MB), or the line feed that ends
a record if ``compressed`` is false. The files hold nothing else.

Reading. A record counts only if all checks hold: gzip checksum and
length, version line, header fields, content length, closing line ends and block
digest. After a failed check the reader looks for the next place where a gzip
member or a version line begins a record that passes, goes on from there, and logs the
bytes between as a quarantined gap with the reason. Records before and after
damage are unharmed by it; the bytes of records and gaps together are the file.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labeltext.llm.bytetext import bounded_batches, released
from labeltext.llm.staging import small_side, stage

BLOCK_BYTES = 4 << 20
BLOCKS_PER_FILE = 16
LEVEL = 4
REVISIT_BYTES = 100
MEMBER_BYTES = (1 << 24) - 1
CHUNK = 1 << 16

# Field names, types and profile of the WARC 1.1 format.
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC = b"\x1f\x8b\x08"
VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
CANDIDATE = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")

RECORD = "archive string, start long, end long, status string, reason string, warc_type string, record_id string, refers_to string, target_uri string, payload_digest string, payload binary"


def make_record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record, uncompressed. White space and control characters of the url are percent-encoded."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if kind == "revisit" else head + payload
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if kind == "revisit":
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE)]
    fields += [
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def members(record: bytes, level: int = LEVEL) -> bytes:
    """The record as one gzip member, or several if it is 16 MB or longer."""
    out = b""
    for at in range(0, len(record), MEMBER_BYTES):
        packer = zlib.compressobj(level, zlib.DEFLATED, 31)
        out += packer.compress(record[at : at + MEMBER_BYTES]) + packer.flush()
    return out


@dataclass
class Found:
    """A checked record and the byte after it, or why there is none."""

    end: int = 0
    reason: str = ""
    fields: dict[str, str] | None = None
    payload: bytes | None = None


def _digest_fits(name: str, data: bytes) -> bool:
    """Whether ``algorithm:value`` (hex or base32) is the data's digest; an unknown algorithm is not checked."""
    algorithm, _, value = name.partition(":")
    if algorithm.lower() not in ("sha1", "sha256", "sha512", "md5"):
        return True
    raw = hashlib.new(algorithm.lower(), data).digest()
    return value.lower() == raw.hex() or value.upper().rstrip("=") == base64.b32encode(raw).decode().rstrip("=")


def parse_record(data: bytes | memoryview, at: int) -> Found:
    """The plain record at ``at``. A record cut short has ``end`` beyond the data."""
    version = VERSION_LINE.match(data, at)
    if not version:
        return Found(reason="no version line")
    head, close = version.end(), re.compile(rb"\r\n\r\n").search(data, version.end())
    if not close:
        return Found(end=len(data) + 1, reason="header cut short")
    fields = {}
    for line in bytes(data[head : close.start()]).split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon or not re.fullmatch(rb"[!-~]+", name):
            return Found(reason="bad header line")
        fields[name.decode().lower()] = value.strip().decode("utf-8", "replace")
    length = fields.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,18}", length) or "warc-type" not in fields:
        return Found(reason="no content length or type")
    start, end = close.end(), close.end() + int(length)
    if end + 4 > len(data):
        return Found(end=end + 4, reason="record cut short")
    if bytes(data[end : end + 4]) != b"\r\n\r\n":
        return Found(reason="no line ends after the block")
    block = bytes(data[start:end])
    if "warc-block-digest" in fields and not _digest_fits(fields["warc-block-digest"], block):
        return Found(reason="wrong block digest")
    payload = None
    if fields["warc-type"].lower() != "revisit":
        http = fields.get("content-type", "").startswith("application/http")
        payload = block.partition(b"\r\n\r\n")[2] if http else block
        if "warc-payload-digest" in fields and not _digest_fits(fields["warc-payload-digest"], payload):
            return Found(reason="wrong payload digest")
    return Found(end=end + 4, fields=fields, payload=payload)


def unpack(data: bytes, at: int) -> tuple[bytes, int] | None:
    """(content, end) of the gzip member at ``at``, its checksum and length verified; else None."""
    unpacker, out, fed = zlib.decompressobj(31), [], at
    try:
        while not unpacker.eof:
            if fed >= len(data):
                return None
            out.append(unpacker.decompress(memoryview(data)[fed : fed + CHUNK]))
            fed = min(fed + CHUNK, len(data))
    except zlib.error:
        return None
    return b"".join(out), fed - len(unpacker.unused_data)


def record_at(data: bytes, at: int) -> Found:
    """The record that begins at ``at``: plain, or in one or more gzip members that hold exactly it."""
    if data[at : at + 3] != MAGIC:
        return parse_record(data, at)
    if (member := unpack(data, at)) is None:
        return Found(reason="damaged gzip member")
    content, end = member
    found = parse_record(content, 0)
    while found.end > len(content) and data[end : end + 3] == MAGIC and (member := unpack(data, end)):
        content, end = content + member[0], member[1]
        found = parse_record(content, 0)
    if not found.fields:
        return Found(reason=found.reason)
    if found.end < len(content):
        return Found(reason="more than a record in a gzip member")
    found.end = end
    return found


def salvage_bytes(data: bytes) -> Iterator[tuple[int, int, Found]]:
    """(start, end, record or reason) of every record and quarantined gap of an archive, in order."""
    at = 0
    while at < len(data):
        found = record_at(data, at)
        if found.fields:
            yield at, found.end, found
            at = found.end
            continue
        gap, reason, search = at, found.reason, at + 1
        while True:
            nxt = CANDIDATE.search(data, search)
            at = nxt.start() if nxt else len(data)
            if nxt is None or record_at(data, at).fields:
                break
            search = at + 1
        yield gap, at, Found(reason=reason)


def with_kinds(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, payload, digest, kind, refers_to): of equal payloads of
    ``least`` bytes or more, those of the smallest page_id are responses."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    groups = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    groups = stage(groups.where("n > 1 and first is not null").select("digest", "first"), "warc-groups")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(small_side(groups), "digest", "left").select(
        "page_id", "url", "payload", "digest", F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("first")).alias("refers_to")
    )


def write(pages: DataFrame, path: str, compressed: bool = True, date: str = "1970-01-01T00:00:00Z", block_bytes: int = BLOCK_BYTES, least: int = REVISIT_BYTES) -> None:
    """Write a record per row of ``pages`` (page_id long, url, html; other columns,
    whatever their names, are ignored) into the new folder ``path``.

    A null html is an empty payload, a null url no target; a null page_id has an
    empty number in its record id and is never the response of a group that
    has an id. Payloads under ``least`` bytes are never revisited. Repeated rows
    of a group's smallest page_id are all responses. A task's records go into files of
    ``BLOCKS_PER_FILE`` blocks; a block ends with the record that brings it to
    ``block_bytes``. An empty table gives a folder without records.
    """
    bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = bytearray()
        for batch in released(batches):
            for page_id, url, payload, digest, kind, refers in zip(*(c.to_pylist() for c in batch.columns)):
                record = make_record(kind, page_id, url, payload, digest, refers, date)
                block += members(record) if compressed else record
                if len(block) >= block_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([bytes(block[:-1])], pa.binary())], ["block"])
                    block.clear()
        if block:
            yield pa.RecordBatch.from_arrays([pa.array([bytes(block[:-1])], pa.binary())], ["block"])

    rows = with_kinds(pages, least).select("page_id", "url", "payload", "digest", "kind", "refers_to")
    blocks = rows.mapInArrow(run, "block binary").select(F.col("block").cast("string").alias("value"))
    blocks.write.option("lineSep", "\x00" if compressed else "\n").option("maxRecordsPerFile", BLOCKS_PER_FILE).text(path)


def salvage(spark: SparkSession, path: str) -> DataFrame:
    """Read the archives under ``path`` (a folder or pattern), plain or of gzip members.

    One row per record (status ``record``) and per quarantined gap (status ``gap``
    with the ``reason`` of the first failed check), with the archive's path and the
    bytes ``start`` to ``end``. Empty files have no rows. A file is read whole
    by one task, as Spark's binary source does (2 GB at most).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.int64(), *(pa.string(),) * 7, pa.binary())
        names = [f.split()[0] for f in RECORD.split(", ")]
        for batch in released(batches):
            for path, content in zip(batch.column("path"), batch.column("content")):
                rows, size = [], 0
                for start, end, found in salvage_bytes(content.as_py()):
                    f = found.fields or {}
                    rows.append((
                        path.as_py(), start, end, "record" if found.fields else "gap", found.reason or None, f.get("warc-type"), f.get("warc-record-id"), f.get("warc-refers-to"),
                        f.get("warc-target-uri"), f.get("warc-payload-digest"), found.payload,
                    ))
                    size += len(found.payload or b"")
                    if size >= BLOCK_BYTES or len(rows) >= 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")
    return files.mapInArrow(run, RECORD)


def page_records(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the
    records that :func:`write` made; a revisit has the size of the response
    that it refers to by id and digest, null if that record is lost."""
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
    rows = records.where("status = 'record'").select(
        number("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("bytes"),
        F.substring_index("payload_digest", ":", -1).alias("payload_digest"), F.col("warc_type").alias("record_type"), number("refers_to").alias("refers_to"),
    )
    rows = stage(rows, "warc-pages")
    full = rows.where("record_type = 'response'").select(F.col("page_id").alias("at"), F.col("payload_digest").alias("digest"), F.col("bytes").alias("full")).distinct()
    revisits = rows.where("record_type = 'revisit'").join(full, (F.col("refers_to") == F.col("at")) & (F.col("payload_digest") == F.col("digest")), "left").withColumn("bytes", F.col("full"))
    both = rows.where("record_type <> 'revisit'").unionByName(revisits.select(rows.columns))
    return both.select("page_id", F.col("bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
