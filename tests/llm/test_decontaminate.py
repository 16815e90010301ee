"""Decontamination against a search for every window of every item in every document."""

import re

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lacuna.llm import decontaminate

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("hits", StringType())])
ITEMS = StructType([StructField("item_id", LongType()), StructField("text", StringType()), StructField("n_words", StringType())])


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text, items, window=10):
    mine = words(text)
    hit, found = set(), set()
    for item_id, item in items:
        w = words(item)
        size = min(window, len(w))
        for k in range(len(w) - size + 1) if size else ():
            for s in range(len(mine) - size + 1):
                if mine[s : s + size] == w[k : k + size]:
                    hit |= set(range(s, s + size))
                    found.add("" if item_id is None else str(item_id))
    return len(mine), sorted(hit), sorted(found)


def result(df):
    return sorted(
        ((r["id"], r["n_words"], [w for a, b in zip(r["hits"][::2], r["hits"][1::2], strict=True) for w in range(a, b)], r["items"]) for r in df.collect()),
        key=repr,
    )


CASES = [
    (1, "a b c d e f g h i j k l m", None), (2, "x A-b c.d e f g h i j! y a b c", "q"), (3, None, None), (4, "", None),
    (5, "short item here and Short ITEM again", None), (5, "short item", None), (None, "k l m a b c d e f g h i j k l m n", None),
    (6, "the the the the the the the the the the the the the", None), (7, "pre é ü ß 日本 x1 2 3 4 5 6 7 post", None),
    (8, "a b c d e f g h i", None), (8, "a b c d e f g h i", None), (9, "z " * 40000 + "b c d e f g h i j k", None),
]
BENCH = [
    (1, "a b c d e f g h i j k l", None), (10, "Short, item", None), (2, "c d e f g h i j k l m n", None), (3, None, None), (4, " ?! ", None),
    (5, "the " * 12, None), (6, "é ü ß 日本 x1 2 3 4 5 6 7", None), (1, "a b c d e f g h i j k l", None), (None, "y", None),
]


@pytest.mark.parametrize("block_words", [500_000, 15, 1])
def test_cases(spark, block_words):
    docs, bench = spark.createDataFrame(CASES, DOCS), spark.createDataFrame(BENCH, ITEMS)
    got = result(decontaminate.contamination(docs, bench, block_words=block_words))
    want = sorted(((i, *brute(t, [(b, x) for b, x, _ in BENCH])) for i, t, _ in CASES), key=repr)
    assert got == want


def test_empty(spark):
    docs, bench = spark.createDataFrame(CASES, DOCS), spark.createDataFrame(BENCH, ITEMS)
    assert decontaminate.contamination(docs.limit(0), bench).collect() == []
    assert all(not h and not i for _, _, h, i in result(decontaminate.contamination(docs, bench.limit(0))))


def test_documents(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    bench = spark.read.parquet(f"{sf_small}/benchmark.parquet")
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    got = result(decontaminate.contamination(docs, bench))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert any(h for _, _, h, _ in got)
    joined = {i: set(words(t)) for i, t in items}
    for i, n, hits, found in got:
        near = [(k, t) for k, t in items if joined[k] & set(words(texts[i]))]
        assert (n, hits, found) == brute(texts[i], near)
