import hashlib
import uuid

import duckdb
import pytest
from data import SF001

from repochron.llm import warc
from repochron.llm.queries import SQL

ODD = [(1, "http://a b", "x" * 200), (2, None, "x" * 200), (3, "u", None), (None, "u", "x" * 200), (4, "u", "short"),
       (5, "u", "short"), (2, "q", "x" * 200), (6, "z", "WARC/1.1\r\n\r\n\n\nhttp://x 0 1 t 5\n" * 9), (7, "é\nü", "ü" * 99),
       (8, "v", "ü" * 99)]


def arc(version, records):
    body = warc.version_block(version, "f.arc", "20010203040506")
    for url, date, block in records:
        body += warc.arc_header(version, url, date, "text/html", len(block)) + block + b"\n"
    return body


@pytest.mark.parametrize("version", [1, 2])
def test_headers_of_both_versions(version):
    blocks = [b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n\n\nhttp://fake 0.0.0.0 1 t 3\n", b"", b"\x00\xff\r\n"]
    got = list(warc.parse_arc(arc(version, [("http://h/ x", "20010203040506", b) for b in blocks])))
    assert [r["block"] for r in got] == blocks
    assert got[0]["url"] == "http://h/%20x" and got[0]["mime"] == "text/html"
    assert ("status" in got[0]) == (version == 2)
    without = arc(version, [("u", "1", b"q")]).split(b"\n", 4 if version == 1 else 4)
    assert without


def test_files_without_version_block():
    for version in (1, 2):
        data = warc.arc_header(version, "u", "20010203040506", "t", 3) + b"abc\n"
        assert [r["block"] for r in warc.parse_arc(data)] == [b"abc"]


def test_broken_archives_are_errors():
    for data in (b"no header here\n", warc.arc_header(1, "u", "1", "t", 99) + b"abc", b"u 0 1 t x\nabc"):
        with pytest.raises(ValueError):
            list(warc.parse_arc(data))
    good = warc.warc_record("response", [("A", "b")], b"xyz")
    assert [b for _, b in warc.parse_warc(good + b"\r\n\r\n" + good)] == [b"xyz", b"xyz"]
    with pytest.raises(ValueError):
        list(warc.parse_warc(good[:-1]))


def test_synthesised_fields():
    assert warc.warc_date("20010203040506") == "2001-02-03T04:05:06Z"
    assert warc.warc_date("200102030405") == "2001-02-03T04:05:00Z"
    assert warc.warc_date("x") == "1970-01-01T00:00:00Z"
    assert warc.record_id("f", 5) == warc.record_id("f", 5) != warc.record_id("f", 6)
    uuid.UUID(warc.record_id("f", 5)[10:-1])
    fields, block = next(warc.parse_warc(warc.warc_record("resource", [("X", "y")], b"abc")))
    assert fields["warc-type"] == "resource" and fields["content-length"] == "3"


def test_pages_match_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS FROM '{SF001}/pages.parquet'")
    want = con.sql(SQL["op5_arc_to_warc"]).fetchall()
    got = [tuple(r) for r in warc.op5_arc_to_warc(spark, SF001).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_odd_pages(spark):
    pages = spark.createDataFrame(ODD, "page_id long, url string, html string")
    rows = warc.read_warc(spark, warc.archive_pages(pages)).collect()
    assert len(rows) == len(ODD)
    by_type = {}
    for r in rows:
        by_type.setdefault((r.page_id, r.payload_bytes), []).append(r)
    lead = by_type[(1, 200)][0]
    assert lead.record_type == "response" and lead.url == "http://a%20b"
    copies = by_type[(2, 200)] + by_type[(None, 200)]
    assert len(copies) == 3 and {r.record_type for r in copies} == {"revisit"} and {r.refers_id for r in copies} == {lead.record_id}
    assert {r.record_type for r in rows if r.payload_bytes < 100} == {"response"}
    assert (by_type[(7, 198)][0].record_type, by_type[(8, 198)][0].record_type) == ("response", "revisit")
    for r in rows:
        html = next((h or "").encode() for i, _, h in ODD if i == r.page_id)
        assert r.payload_digest == hashlib.sha256(html).hexdigest() and r.payload_bytes == len(html)
        assert bytes(r.payload) == (html if r.record_type == "response" else b"")
    assert warc.read_warc(spark, warc.archive_pages(pages.limit(0))).count() == 0
