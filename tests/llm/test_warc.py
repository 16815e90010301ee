"""WARC archives and their index: round trip of every page, against direct hashing and grouping."""

import gzip
import hashlib
import random

from pyspark.sql.types import LongType, StringType, StructField, StructType

from lacuna.llm import warc

SCHEMA = StructType([StructField("page_id", LongType()), StructField("url", StringType()), StructField("html", StringType()), StructField("key", StringType())])


def brute(rows):
    first = {}
    for i, _, h in rows:
        payload = (h or "").encode()
        if len(payload) >= 100:
            o = (i is None, i or 0)
            first[payload] = min(first.get(payload, o), o)
    out = []
    for i, _, h in rows:
        payload = (h or "").encode()
        at = first.get(payload)
        revisit = at is not None and at != (i is None, i or 0)
        out.append((i, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if revisit else "response", at[1] if revisit else None))
    return sorted(out, key=repr)


def through_index(pages, **sizes):
    captures = warc.write(pages)
    index = warc.build_index(captures, **sizes)
    return warc.read(warc.lookup(index, warc.keys_of(pages)))


def result(df):
    return sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in df.collect()), key=repr)


BIG = "é<p>same payload</p>\r\n\r\n" * 20
CASES = [
    (5, "http://www.example.com/a?x=1#top", BIG, None), (3, "https://Blog.Example.com:8080/b", BIG, "k"), (9, None, BIG, None), (9, None, BIG, None),
    (1, "http://www.example.com/a?x=1#top", "tiny", None), (2, "not a url", "tiny", None), (4, "http://[bad", None, None), (6, "", "", None),
    (None, "http://x.y/é\t\n%09", BIG, None), (None, None, "only null ids " * 20, None), (None, None, "only null ids " * 20, None), (7, "http://x.y/z", "W" * 3_000_000, None),
    (8, "http://x.y/z", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n" * 9, None),
]


def test_keys():
    assert warc.surt("http://www.Example.com/a?x=1#top") == "com,example,www)/a?x=1"
    assert warc.surt("https://example.com:8080") == "com,example:8080)/"
    assert [warc.surt(u) for u in (None, "", "not a url", "http://[bad")] == ["", "", "not a url", "http://[bad"]


def test_cases(spark):
    pages = spark.createDataFrame(CASES, SCHEMA)
    got = through_index(pages, block_lines=2, shard_blocks=2)
    assert result(got) == brute([r[:3] for r in CASES])
    texts = {r["page_id"]: r["payload"] for r in got.collect() if r["record_type"] == "response" and r["page_id"]}
    assert texts[7] == CASES[-2][2] and texts[8] == CASES[-1][2] and texts[6] == ""
    assert through_index(pages.limit(0)).collect() == []


def test_lookups(spark):
    rng = random.Random(6)
    rows = [(i, f"http://h{rng.randint(0, 5)}.example.org/p{rng.randint(0, 40)}", f"text {i}", None) for i in range(500)]
    rows += [(1000, "http://same.example.org/", f"body {k}", None) for k in range(60)]
    pages = spark.createDataFrame(rows, SCHEMA)
    captures = warc.write(pages)
    index = warc.build_index(captures, block_lines=7, shard_blocks=3)
    assert result(warc.read(warc.lookup(index, warc.keys_of(pages)))) == brute([r[:3] for r in rows])
    wanted = spark.createDataFrame([("org,example,h1)/p1", 10**6), ("zzz", 1), ("", None), (warc.surt(rows[3][1]), 3), (warc.surt(rows[3][1]), 3)], "key string, page_id long")
    assert [r["page_id"] for r in warc.lookup(index, wanted).collect()] == [3]


def test_archives_are_plain_warc(spark):
    pages = spark.createDataFrame(CASES, SCHEMA)
    files = {r["file"] for r in warc.write(pages).collect()}
    found = []
    for f in files:
        raw = gzip.open(f.removeprefix("file:")).read()
        while raw:
            head, rest = raw.split(b"\r\n\r\n", 1)
            size = int(head.rsplit(b"Content-Length: ", 1)[1])
            assert rest[size : size + 4] == b"\r\n\r\n"
            found.append(warc.parse_record(raw[: len(head) + 8 + size])["page_id"])
            raw = rest[size + 4 :]
    assert sorted(found, key=repr) == sorted((r[0] for r in CASES), key=repr)


def test_pages(spark, sf_small):
    pages = spark.read.parquet(f"{sf_small}/pages.parquet")
    assert result(through_index(pages, block_lines=10)) == brute([(r["page_id"], r["url"], r["html"]) for r in pages.collect()])
