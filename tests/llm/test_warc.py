"""WARC round trips, kinds of records, and salvage of damaged archives."""

import glob
import gzip
import hashlib
import random

import pytest

from labeltext.llm import sqltext, warc
from labeltext.llm.queries import QUERIES

FIELDS = "page_id long, url string, html string"
LONG = "<p>" + "same text " * 20 + "</p>"


def page_rows():
    rows = [(i, f"http://h{i % 3}.example.com/{i}", f"<html><body>page {i} " + "x" * (i * 7) + "</body></html>") for i in range(40)]
    rows += [(100, "http://a/", LONG), (99, "http://b/", LONG), (101, None, LONG), (99, "http://b/", LONG), (None, "http://c/", LONG)]
    rows += [(110, "http://d/", "short"), (111, "http://e/", "short"), (112, None, None), (113, "", ""), (114, "http://x/\r\nWARC-Type: bad y", "ünï 漢字 😀" * 30)]
    rows += [(None, "http://n/", LONG + "n"), (None, "http://n/", LONG + "n"), (120, "http://w/", "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n\x1f"), (130, "http://long/", "<p>word</p>" * 200_000)]
    return rows + [(99, "http://b/", "another text " * 30)]


def naive_records(rows):
    data = [(i, (h or "").encode()) for i, _, h in rows]
    out = []
    for i, b in data:
        same = [j for j, c in data if c == b and j is not None]
        first = min(same) if same and len(b) >= 100 else None
        revisit = first is not None and i != first
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(map(repr, out))


@pytest.mark.parametrize("compressed", [True, False])
def test_pages_round_trip(spark, tmp_path, compressed):
    rows = page_rows()
    pages = spark.createDataFrame([(*r, "a", 1, b"z") for r in rows], FIELDS + ", digest string, kind int, payload binary").repartition(3)
    path = str(tmp_path / "archives")
    warc.write(pages, path, compressed, block_bytes=2000)
    records = warc.salvage(spark, path)
    assert sorted(map(repr, map(tuple, warc.page_records(records).collect()))) == naive_records(rows)
    got = records.collect()
    assert {r["status"] for r in got} == {"record"}
    by_digest = {hashlib.sha256((h or "").encode()).hexdigest(): (h or "").encode() for _, _, h in rows}
    assert all(r["payload"] == by_digest[r["payload_digest"].removeprefix("sha256:")] for r in got if r["warc_type"] == "response")
    assert {r["target_uri"] for r in got} >= {None, "", "http://x/%0D%0AWARC-Type:%20bad%20y"}
    for name in glob.glob(path + "/part-*"):
        data = open(name, "rb").read()
        whole = gzip.decompress(data) if compressed and data else data
        mine = [r for r in got if r["archive"].endswith(name)]
        assert whole.count(b"WARC-Record-ID: ") == len(mine)  # any gzip reader reads it
        spans = sorted((r["start"], r["end"]) for r in mine)
        assert [s for s, _ in spans] + [len(data)] == [0] + [e for _, e in spans]


def test_query_over_its_table(spark, duck):
    rows = QUERIES["op13_warc_salvage"](spark, "/root/testdata/sf0.001")
    got = rows.select(sorted(rows.columns)).collect()
    want = duck.execute(sqltext.ORACLE["op13_warc_salvage"]).fetchall()
    assert len(got) and sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "none")
    warc.write(spark.createDataFrame([], FIELDS), path)
    assert warc.salvage(spark, path).collect() == [] and warc.page_records(warc.salvage(spark, path)).collect() == []


def archive(r, compressed, n=12):
    parts = []
    for i in range(n):
        payload = bytes(r.randrange(256) for _ in range(r.randrange(400))) + r.choice([b"", b"\nWARC/1.1\r\n", warc.MAGIC, b"\r\n\r\n", b"\nWARC/1.0\r\nWARC-Type: a\r\nContent-Length: 9\r\n\r\n"])
        record = warc.make_record("response", i, f"http://a/{i}", payload, hashlib.sha256(payload).hexdigest(), None, "1970-01-01T00:00:00Z")
        parts.append(warc.members(record) if compressed else record)
    return parts


@pytest.mark.parametrize("compressed", [True, False])
def test_salvage_recovers_all_that_is_unharmed(compressed):
    r = random.Random(11)
    for _ in range(150):
        parts = archive(r, compressed)
        hurt, damaged = set(), []
        for i, part in enumerate(parts):
            kind = r.choice(["flip", "cut", "drop", "zero", "", "", "", "", ""])
            at = r.randrange(len(part))
            if kind == "flip":
                if compressed and 4 <= at < 10:  # time stamp and system in a gzip header are not covered by its checksum
                    at = len(part) - 5
                part = part[:at] + bytes([part[at] ^ 0x55]) + part[at + 1 :]
            elif kind == "cut":
                part = part[:at]
            elif kind == "drop":
                part = part[:at] + part[at + 1 :]
            elif kind == "zero":
                part = part[: at // 2] + bytes(len(part) - at // 2)
            if kind:
                hurt.add(i)
            elif r.random() < 0.15:
                part = part + bytes(r.randrange(256) for _ in range(r.randrange(1, 60)))
            damaged.append(part)
        data = b"".join(damaged)
        found = list(warc.salvage_bytes(data))
        ends = [0] + [e for _, e, _ in found]
        assert [s for s, _, _ in found] == ends[:-1] and ends[-1] == len(data)  # records and gaps tile the file
        ids = [f.fields["warc-record-id"] for _, _, f in found if f.fields and "warc-record-id" in f.fields]
        assert set(ids) >= {f"<urn:page:{i}>" for i in range(12) if i not in hurt}
        assert all(f.reason for _, _, f in found if not f.fields)
        assert (len(ids) == 12) or any(not f.fields for _, _, f in found)


def test_reasons_and_foreign_archives():
    record = warc.make_record("response", 1, "http://a/", b"body", hashlib.sha256(b"body").hexdigest(), None, "2020-01-01T00:00:00Z")
    bad = record.replace(b"body", b"BODY")
    found = list(warc.salvage_bytes(bad + record))
    assert [(s, e, f.reason) for s, e, f in found] == [(0, len(bad), "wrong block digest"), (len(bad), len(bad) + len(record), "")]
    assert [f.reason for _, _, f in warc.salvage_bytes(b"junk" + gzip.compress(b"no warc") + record[:-3])] == ["no version line"]
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 4\r\nWARC-Block-Digest: sha1:" + __import__("base64").b32encode(hashlib.sha1(b"a: b").digest()) + b"\r\n\r\na: b\r\n\r\n"
    two = list(warc.salvage_bytes(gzip.compress(info) + gzip.compress(record)))
    assert [f.fields["warc-type"] for _, _, f in two] == ["warcinfo", "response"] and two[0][2].payload == b"a: b" and two[1][2].payload == b"body"


def test_record_of_several_members():
    payload = random.Random(1).randbytes(1 << 20) * 17
    record = warc.make_record("response", 7, None, payload, hashlib.sha256(payload).hexdigest(), None, "2020-01-01T00:00:00Z")
    small = warc.make_record("response", 8, None, b"x", hashlib.sha256(b"x").hexdigest(), None, "2020-01-01T00:00:00Z")
    data = warc.members(record, 1) + warc.members(small)
    assert data.endswith(b"\x00") and data.count(warc.MAGIC) >= 3 and gzip.decompress(data) == record + small
    found = list(warc.salvage_bytes(data))
    assert [f.fields["warc-record-id"] for _, _, f in found] == ["<urn:page:7>", "<urn:page:8>"] and found[0][2].payload == payload
