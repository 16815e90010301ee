"""Exact top-k search against all inner products in Python integers."""

import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from lacuna.llm import topk

SCHEMA = StructType([StructField("vec_id", LongType()), StructField("embedding", ArrayType(DoubleType())), StructField("score", IntegerType())])


def brute(rows, asked, k=10):
    usable = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(usable):
        if i is None or not asked(i):
            continue
        scores = [(-max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(q, c)))), j is None, j) for b, (j, c) in enumerate(usable) if b != a]  # noqa: B905
        out += [(i, r + 1, j, -s) for r, (s, _, j) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=repr)


def result(df):
    return sorted(((r["query_id"], r["rank"], r["id"], r["score"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("query_block, candidate_block", [(4096, 32768), (7, 40), (1, 9)])
def test_blocks(spark, query_block, candidate_block):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) * (1 + i % 5) for _ in range(8)]) for i in range(300)]
    rows += [(i, list(rows[7][1])) for i in range(300, 340)] + [(400 + i, [0.5] * 8) for i in range(30)]
    df = spark.createDataFrame([(i, v, None) for i, v in rows], SCHEMA)
    got = topk.search(df, F.col("id") % 20 == 0, query_block=query_block, candidate_block=candidate_block)
    assert result(got) == brute(rows, lambda i: i % 20 == 0)


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, []), (20, [0.1]),
        (None, [3.0, 3.0]), (6, [-1.0, -2.0]), (7, [3.0, 3.0]), (8, [1e20, 1e20]), (9, [-1e300, 2.0]), (40, [0.0, 0.0]),
    ]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA)
    asked = F.col("id") % 20 == 0
    assert result(topk.search(df, asked)) == brute(rows, lambda i: i % 20 == 0)
    assert result(topk.search(df, asked, k=3, candidate_block=3)) == brute(rows, lambda i: i % 20 == 0, 3)
    assert topk.search(df.limit(0), asked).collect() == []
    assert topk.search(df.where("vec_id = 0").limit(1), asked).collect() == []


def test_embeddings(spark, sf_small):
    df = spark.read.parquet(f"{sf_small}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    assert result(topk.search(df, F.col("id") % 20 == 0, candidate_block=64)) == brute(rows, lambda i: i % 20 == 0)
