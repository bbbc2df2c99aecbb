import gzip
import hashlib
import io

import pytest

from hardwood.llm import warc
from hardwood.llm.common import Scratch
from tests.llm.helpers import frame, tables

PAGES = "page_id long, url string, html string"
ROWS = [
    (1, "http://a/", "<p>one</p>"), (2, "http://b/", "<p>one</p>"), (3, None, None), (4, "http://c/ x\n", ""), (5, "http://d/", "ü\r\n\r\nWARC/1.1\r\n"), (None, "http://e/", "<p>one</p>"),
    (7, "http://f/", "z" * 300_000), (7, "http://f/", "z" * 300_000), (9, "", "last"),
]


def test_round_trip(spark, tmp_path):
    d = tables(spark, tmp_path, pages=frame(spark, ROWS, PAGES))
    got = warc.op2_warc_roundtrip(spark, d).collect()
    assert len(got) == len(ROWS) and all(r.verified and r.error is None for r in got)
    largest = {}
    for i, _, h in ROWS:
        if i is not None:
            largest[h or ""] = max(i, largest.get(h or "", -1))
    for r, (i, _, h) in zip(sorted(got, key=lambda r: (r.page_id is None, r.page_id or 0)), sorted(ROWS, key=lambda r: (r[0] is None, r[0] or 0)), strict=True):
        data = (h or "").encode()
        first = largest[h or ""]
        assert (r.page_id, r.payload_bytes) == (i, len(data)) and r.payload_digest == warc.sha1_base32(data)
        assert (r.record_type, r.refers_to) == (("response", None) if i == first else ("revisit", first))


def test_payloads_and_small_records(spark):
    scratch = Scratch(spark, "t")
    planned = warc.plan_revisits(frame(spark, ROWS, PAGES), scratch, min_bytes=100)
    archives = scratch.keep(warc.write_archives(planned, scratch.path("a"), archive_bytes=200), "m")
    got = {r.page_id: r for r in warc.read_archives(archives, payloads=True).collect()}
    assert got[1].record_type == got[2].record_type == "response" and bytes(got[2].payload) == b"<p>one</p>"
    assert archives.count() > 2 and archives.agg({"records": "sum"}).first()[0] == len(ROWS)


def test_members_are_read_one_by_one():
    records = [warc.record_bytes(i, "u", b"x" * n, None, "d") for i, n in enumerate((0, 10, 200_000))]
    parts = list(warc.members(io.BytesIO(b"".join(records)), chunk=7))
    assert [o for o, _ in parts] == [0, len(records[0]), len(records[0]) + len(records[1])]
    assert b"".join(p for _, p in parts) == gzip.decompress(b"".join(records))


@pytest.mark.parametrize("change", [lambda b: b[:-9], lambda b: b[:30] + bytes([b[30] ^ 255]) + b[31:], lambda b: gzip.compress(b"no warc"), lambda b: gzip.compress(gzip.decompress(b) + b"more")])
def test_damage_is_seen(change):
    data = warc.record_bytes(1, "u", b"payload" * 50, None, "d")
    with pytest.raises(warc.Damaged):
        for _, part in warc.members(io.BytesIO(change(data))):
            warc.parse_record(part)


def test_wrong_digest_is_reported():
    headers, block = warc.parse_record(gzip.decompress(warc.record_bytes(1, "u", b"payload", None, "d")))
    assert warc.read_record(headers, block)["verified"]
    assert not warc.read_record(headers, block.replace(b"payload", b"Payload"))["verified"]
    assert hashlib.sha1(b"").hexdigest() == "da39a3ee5e6b4b0d3255bfef95601890afd80709"


def test_empty_table(spark, tmp_path):
    assert warc.op2_warc_roundtrip(spark, tables(spark, tmp_path, pages=frame(spark, [], PAGES))).count() == 0


def test_names_of_file_systems():
    given = ("s3a://b/x", "s3n://b/x", "s3://b/x", "file:/tmp/x", "file:///tmp/x", "hdfs://n/x", "gs://b/s3a://x")
    assert [warc.arrow_uri(u) for u in given] == ["s3://b/x", "s3://b/x", "s3://b/x", "file:///tmp/x", "file:///tmp/x", "hdfs://n/x", "gs://b/s3a://x"]


def test_clashing_columns(spark):
    pages = frame(spark, ROWS, PAGES).selectExpr("*", "1 as payload", "2 as _key", "3 as _first", "4 as refers_to", "5 as _sha")
    planned = warc.plan_revisits(pages, Scratch(spark, "t"))
    assert planned.columns == ["page_id", "url", "payload", "refers_to"]
    assert sorted(bytes(r.payload) for r in planned.collect()) == sorted((h or "").encode() for _, _, h in ROWS)
