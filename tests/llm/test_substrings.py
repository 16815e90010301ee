"""Substring deduplication against all windows of all documents."""

import hashlib
import random
import re

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lacuna.llm import substrings

SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("kept", StringType())])


def brute(rows, window=50):
    first = {}
    split = [(i if i is not None else 1 << 63, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for (i, _), (o, w) in zip(rows, split, strict=True):
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < o:
                gone |= set(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r["id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect()), key=repr)


def made(seed, docs=60, window=50):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 3)))
    passages = [[word() for _ in range(rng.randint(window - 3, 3 * window))] for _ in range(5)] + [["x"] * (3 * window), ["a", "b"] * window]
    rows = []
    for i in range(docs):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += [word() for _ in range(rng.randint(0, 70))]
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 3)
            words += p[a : rng.randint(len(p) // 2, len(p))]
        rows.append((rng.choice([i, i, i, i // 2]), rng.choice([" ", "\n", " \t "]).join(words)))
    rows += rng.choices(rows, k=8) + [(None, rows[3][1]), (None, None), (1000, ""), (1001, " \n ")]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_made_documents(spark, seed):
    rows = made(seed)
    df = spark.createDataFrame([(i, t, "q") for i, t in rows], SCHEMA)
    got = result(substrings.deduplicated(df))
    assert got == brute(rows) and any(r[2] for r in got)


def test_small_window(spark):
    rows = made(7, window=12)
    df = spark.createDataFrame([(i, t, None) for i, t in rows], SCHEMA)
    assert result(substrings.deduplicated(df, window=12, anchor=4)) == brute(rows, 12)


def test_chunks_of_very_long_texts(spark, monkeypatch):
    monkeypatch.setattr(substrings, "_CHUNK", 64)
    rows = made(9, docs=20)
    hasher = substrings.Hasher()
    for _, t in rows:
        words = (t or "").encode().split()
        _, _, pos, n = substrings.runs_of(words, hasher)
        assert [w for p, c in zip(pos, n, strict=True) for w in range(p, p + c)] == list(range(max(0, len(words) - 49)))


def test_documents_and_text(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    out = substrings.deduplicated(docs, with_text=True)
    assert result(out) == brute(rows)
    for r in out.collect():
        assert hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"]
    assert substrings.deduplicated(docs.limit(0)).collect() == []
