import base64
import gzip
import hashlib

from pyspark.sql import functions as F

from tessera.llm import warc
from tessera.llm.common import scratch_path

PAGES = [
    (1, "http://B.example.com/x?q=1#f", "<p>é</p>"), (2, "https://a.example.com/", "<p>é</p>"), (3, None, None), (4, "no scheme", ""), (5, "http://a.example.com/", "alone"),
    (6, "http://a.example.com/", "WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\n"), (7, "line\r\nbreak", "x" * 300000), (7, "line\r\nbreak", "x" * 300000), (None, "http://a.example.com/", "alone"), (2, "https://a.example.com/", "<p>é</p>"),
]
SCHEMA = "page_id long, url string, html string, key string, file string"


def frame(spark):
    return spark.createDataFrame([(*p, "clash", "clash") for p in PAGES], SCHEMA)


def expect(pages, least=0):
    out = []
    for i, u, h in pages:
        data = (h or "").encode()
        ids = [j for j, _, x in pages if (x or "") == (h or "") and j is not None]
        first = max(ids) if ids and len(data) >= least and sum((x or "") == (h or "") for _, _, x in pages) > 1 else i
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first == i else "revisit", None if first == i else first, u))
    return sorted(out, key=str)


def test_round_trip(spark):
    got = warc.round_trip(frame(spark)).collect()
    assert sorted(map(tuple, got), key=str) == expect(PAGES)
    assert sorted(map(tuple, warc.round_trip(frame(spark), least=6).collect()), key=str) == expect(PAGES, 6)


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_members_and_payloads(spark):
    root = scratch_path(spark, "warc-test")
    captures = warc.write(frame(spark), root)
    index = warc.build(captures, root, block_lines=2)
    assert index.directory.count() >= len(PAGES) // 2
    keys = frame(spark).select(warc.url_key(F.col("url")).alias("key"))
    records = warc.fetch(index, warc.locate(index, keys)).collect()
    assert len(records) == len(PAGES)
    for r in records:
        if r.record_type == "response":
            assert base64.b32encode(hashlib.sha1(bytes(r.payload)).digest()).decode() == r.payload_digest
    one = keys.where("key = 'com,example,a)/'").limit(1)
    assert sorted(str(r.page_id) for r in warc.fetch(index, warc.locate(index, one)).collect()) == ["2", "2", "5", "6", "None"]
    assert warc.locate(index, spark.createDataFrame([("zzz",), ("com,example,a)",)], "key string")).count() == 0
    member = warc.record(1, "u", b"payload", warc.digest(b"payload"), None)
    assert gzip.decompress(member).startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and warc.parse(member)[6] == b"payload"


def test_keys(spark):
    urls = ["HTTP://Www.Example.COM/A?b#c", "https://example.com", None, "plain/path"]
    got = [r.k for r in spark.createDataFrame([(u,) for u in urls], "u string").select(warc.url_key(F.col("u")).alias("k")).collect()]
    assert got == ["com,example,www)/a?b", "com,example)", ")", "plain)/path"]


def test_one_key_in_many_blocks(spark, clashing):
    """A key that most captures have lies in many blocks, which several tasks search."""
    pages = clashing([(i, None if i % 3 else f"http://h{i}.example/") for i in range(300)]).withColumnsRenamed({"doc_id": "page_id", "text": "url", "source": "html"})
    root = scratch_path(spark, "warc-hot")
    index = warc.build(warc.write(pages, root), root, block_lines=7)
    keys = pages.select(warc.url_key(F.col("url")).alias("key"))
    found = warc.locate(index, keys)
    assert sorted(r.page_id for r in found.collect()) == list(range(300))
    assert found.where("key = ')'").select(F.spark_partition_id()).distinct().count() > 1
    assert sorted(r.page_id for r in warc.round_trip(pages).collect()) == list(range(300))
