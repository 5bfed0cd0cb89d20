"""op9."""

import gzip
import hashlib

import pytest

from brindle.llm import common, queries, warc


def test_query_matches_sql(spark, sf, duck):
    got = sorted(tuple(r) for r in queries.op9_warc(spark, sf).collect())
    assert got == sorted(duck.sql("SELECT page_id, payload_bytes, payload_digest, record_type, refers_to FROM (" + queries.ORACLE_SQL["op9_warc"] + ")").fetchall())


@pytest.mark.parametrize("page", [0, 1, 999, 2**63 - 1, -5, None])
def test_record_ids(page):
    assert warc.page_of(warc.record_id(page)) == page


@pytest.mark.parametrize("url, key", [
    ("http://m.a.example.net/en/25#top", "net,example,a,m)/en/25"), ("HTTPS://Example.COM:443?x=1", "com,example)/?x=1"), ("http://h.org:8080/p", "org,h:8080)/p"), ("urn:x-page:7", "urn:x-page:7"), ("http://[bad", "http://[bad"), ("http://h.org:99999/", "http://h.org:99999/"),
])
def test_keys(url, key):
    assert warc.surt(url) == key


def test_records_are_plain_gzip_members():
    body = "héllo".encode()
    a = warc.pack_record(7, "http://x.org/", body, len(body), hashlib.sha1(body).hexdigest(), None, False)
    b = warc.pack_record(8, "http://x.org/", body, len(body), hashlib.sha1(body).hexdigest(), 7, True)
    assert gzip.decompress(a + b).count(b"WARC/1.1\r\n") == 2
    head, http, payload = warc.read_record(a)
    assert payload == body and head["warc-type"] == "response" and int(http["content-length"]) == len(body)
    head, http, payload = warc.read_record(b)
    assert payload == b"" and head["warc-type"] == "revisit" and warc.page_of(head["warc-refers-to"]) == 7


def odd_pages(spark):
    big, other = "<p>" + "x" * 2000, "<p>é" + "y" * 1000
    rows = [(1, "http://a.org/1", big), (2, "http://a.org/2", big), (9, None, big), (3, "http://a.org/1", "small"), (4, "http://b.org", "small"), (5, "", None), (6, " bad url\r\nX: y", ""), (7, "http://c.org", other), (7, "http://c.org", other), (8, "http://c.org/8", other), (None, "http://d.org", big), (10, "http://e.org", "z" * 999), (11, "http://e.org", "z" * 999), (12, "http://f.org", "\r\n\r\n" * 400)]
    return spark.createDataFrame([(*r, 1, "k", "d") for r in rows], "page_id long, url string, html string, size long, key string, digest string")


def test_odd_pages(spark):
    pages = odd_pages(spark)
    directory = warc.write_archives(pages, common.fresh_dir(spark, "w"))
    rows = warc.read_archives(directory).collect()
    kinds = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"] or 0) for r in rows)
    assert kinds == [(0, "revisit", 9), (1, "revisit", 9), (2, "revisit", 9), (3, "response", 0), (4, "response", 0), (5, "response", 0), (6, "response", 0), (7, "revisit", 8), (7, "revisit", 8), (8, "response", 0), (9, "response", 0), (10, "response", 0), (11, "response", 0), (12, "response", 0)]
    full = {r["page_id"]: (r["html"] or "").encode() for r in pages.collect()}
    assert all((r["payload_bytes"], r["payload_digest"]) == (len(full[r["page_id"]]), hashlib.sha1(full[r["page_id"]]).hexdigest()) for r in rows)
    assert warc.read_archives(warc.write_archives(pages.limit(0), common.fresh_dir(spark, "w"))).count() == 0


@pytest.mark.parametrize("lines", [1, 2, 3000])
def test_lookup(spark, monkeypatch, lines):
    monkeypatch.setattr(warc, "LINES", lines)
    directory = warc.write_archives(odd_pages(spark), common.fresh_dir(spark, "w")).cache()
    found = list(warc.lookup(directory, "https://a.org/1#x"))
    assert sorted(c["page_id"] for c in found) == [1, 3]
    assert {c["page_id"]: warc.read_record(c["member"])[2] for c in found}[3] == b"small"
    assert len(list(warc.lookup(directory, "http://c.org/"))) == 2 and list(warc.lookup(directory, "http://nowhere.net/")) == []


def test_reading_tasks_follow_the_bytes(spark, sf, monkeypatch):
    """One large file is read by several tasks, and none reads much more than its share."""
    monkeypatch.setattr(warc, "BYTES_EACH", 20_000)
    pages = spark.read.parquet(f"{sf}/pages.parquet").coalesce(1)
    directory = warc.write_archives(pages, common.fresh_dir(spark, "w")).cache()
    size = directory.agg({"record_bytes": "sum"}).first()[0]
    sizes = warc.places_of(directory).rdd.mapPartitions(lambda rows: [sum(r["size"] for r in rows)]).collect()
    assert sum(sizes) == size and len(sizes) >= size // 20_000 and max(sizes) < 100_000
    assert warc.read_archives(directory).count() == pages.count()


def test_files_roll(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 1)
    folder = common.fresh_dir(spark, "w")
    directory = warc.write_archives(odd_pages(spark).coalesce(1), folder)
    assert warc.read_archives(directory).count() == 14
