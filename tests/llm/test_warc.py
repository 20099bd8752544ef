import base64
import gzip
import hashlib

import pytest

from tidemark.llm import warc

ROWS = [
    (1, "http://a/1", "<p>one</p>", "x"),
    (2, "http://a/2", "<p>one</p>", "x"),
    (9, "http://b/9", "<p>one</p>", "x"),
    (3, None, None, "x"),
    (4, "http://c/\r\nWARC-Type: fake", "", "x"),
    (5, "http://d", "é\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 3, "x"),
    (None, "http://e", "no id", "x"),
    (6, "http://f", "z" * 400_000, "x"),
    (6, "http://f", "z" * 400_000, "x"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(ROWS, "page_id bigint, url string, html string, payload string")


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_round_trip_with_revisits(spark, pages):
    path = warc.archived(pages)
    got = sorted((tuple(r) for r in warc.pages_of(warc.read(spark, path)).drop("payload_sha1").collect()), key=str)
    head = {"<p>one</p>": 9, "": 4, None: 4, "z" * 400_000: 6}
    want = []
    for i, _, html, _ in ROWS:
        to = head.get(html)
        again = to is not None and to != i
        want.append((i, len((html or "").encode()), digest(html), "revisit" if again else "response", to if again else None))
    assert got == sorted(want, key=str)
    bodies = {r["record_id"]: r["payload"] for r in warc.read(spark, path).collect()}
    assert bodies["<urn:page:5>"] == bytearray(ROWS[5][2].encode()) and bodies["<urn:page:1>"] is None and bodies["<urn:page:4>"] == b""


def test_smaller_payloads_stay_responses(spark, pages):
    found = warc.pages_of(warc.read(spark, warc.archived(pages, min_bytes=100)))
    assert {r["page_id"] for r in found.filter("record_type = 'revisit'").collect()} == set()


def test_predicates_reach_the_reader_and_payloads_can_stay_packed(spark, pages):
    path = warc.archived(pages)
    some = warc.read(spark, path, payload=False).filter("record_type = 'revisit' and target_uri like 'http://a/%'")
    plan = some._jdf.queryExecution().executedPlan().treeString()
    assert sorted(r["record_id"] for r in some.collect()) == ["<urn:page:1>", "<urn:page:2>"]
    assert "PushedFilters" not in plan or "record_type" in plan
    reader = warc.WarcReader(path, True)
    from pyspark.sql.datasource import EqualTo, GreaterThan

    rest = list(reader.pushFilters([EqualTo(("record_id",), "<urn:page:9>"), GreaterThan(("payload_length",), 1)]))
    assert len(rest) == 1 and [b.num_rows for p in reader.partitions() for b in reader.read(p)] == [1]
    assert warc.read(spark, path, payload=False).filter("payload is not null").count() == 0


def test_empty_table_and_foreign_archive(spark, pages, tmp_path):
    assert warc.read(spark, warc.archived(pages.limit(0))).count() == 0
    info = b"WARC/1.0\r\nwarc-type: warcinfo\r\nContent-Length: 4\r\n\r\na: b\r\n\r\n"
    page = warc.record_bytes({"payload": b"hi", "record_type": "response", "record_id": "<urn:x>", "date": "d", "target_uri": "u", "refers_to": None})
    (tmp_path / "one.warc.gz").write_bytes(gzip.compress(info) + gzip.compress(page))
    (tmp_path / "two.warc").write_bytes(info + page)
    rows = warc.read(spark, str(tmp_path)).orderBy("record_type").collect()
    assert [(r["record_type"], bytes(r["payload"])) for r in rows] == [("response", b"hi")] * 2 + [("warcinfo", b"a: b")] * 2
