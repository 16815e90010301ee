"""Hard negatives against all inner products in Python integers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from lacuna.llm import negatives

SCHEMA = StructType([
    StructField("vec_id", LongType()), StructField("embedding", ArrayType(DoubleType())), StructField("label", IntegerType()),
    StructField("id", StringType()), StructField("score", StringType()),
])
ENDS = -(1 << 63), (1 << 63) - 1


def brute(rows, asked, n_pos=5, n_neg=10):
    good = [(i, [math.floor(256 * x) for x in v], t) for i, v, t in rows if t is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q, t) in enumerate(good):
        if i is None or not asked(i):
            continue
        order = lambda x: (-x[0], x[1] is None, x[1] or 0)
        scored = [(min(ENDS[1], max(ENDS[0], sum(x * y for x, y in zip(q, c)))), j, u) for b, (j, c, u) in enumerate(good) if b != a]  # noqa: B905
        for ps, pid, _ in sorted([x for x in scored if x[2] == t], key=order)[:n_pos]:
            inside = [x for x in scored if x[2] != t and 30 * ps <= 100 * x[0] <= 90 * ps]
            out += [(i, pid, r + 1, j, ps, s) for r, (s, j, _) in enumerate(sorted(inside, key=order)[:n_neg])]
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, t, "x", "y") for i, v, t in rows], SCHEMA)


@pytest.mark.parametrize("bound", [0, 1, 1000, 1 << 61, 1 << 62, 10**30, 10**300])
def test_residues(bound):
    rng = random.Random(bound)
    for _ in range(20):
        whole = [rng.randint(-bound, bound) for _ in range(7)] + [-bound, bound, 0]
        primes = negatives.moduli(bound)
        parts = [np.array([math.fmod(x % p, p) for x in whole], np.float32).reshape(2, 5) for p in primes]
        got = negatives.remaindered(parts, primes).ravel().tolist()
        assert got == [min(ENDS[1], max(ENDS[0], x)) for x in whole]


def test_product_is_exact():
    rng = np.random.default_rng(1)
    a, c = (np.floor(rng.normal(0, 1e6, (n, 700))) for n in (5, 6))
    for p in negatives.moduli(10**200):
        got = negatives.product_modulo(negatives.residues(a, p), negatives.residues(c, p), p).astype(int) % p
        want = np.array([[sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) % p for s in c] for r in a])
        assert (got == want).all()


@pytest.mark.parametrize("block", [9, 64, 32768])
def test_blocks(spark, block):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0.2, 1) for _ in range(6)], rng.choice([0, 0, 0, 1, 2])) for i in range(300)]
    rows += [(i, list(rows[20][1]), i % 2) for i in range(300, 360)]  # many ties
    want = brute(rows, lambda i: i % 20 == 0)
    assert want and result(negatives.mine(frame(spark, rows), F.col("id") % 20 == 0, candidate_block=block, least_block=block)) == want


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (1, None, 1), (2, [1.0, None], 1), (3, [float("nan"), 1.0], 2), (4, [float("inf"), 1.0], 1), (5, [], 2),
        (20, [0.1], 2), (None, [0.5, 0.5], 2), (6, [-1.0, -2.0], 1), (7, [0.5, 1.0], None), (8, [1e20, 1e20], 1), (9, [-1e300, 2.0], 2), (40, [0.0, 0.0], 3),
        (10, [0.4, 0.8], 2), (11, [0.4, 0.8], 2), (60, [1e20, 1.0], 2), (80, [-1.0, -1.0], 3), (12, [1.0, 1.0], 3), (13, [0.3, 0.1], 1), (14, [-0.3, -0.1], 1),
    ]
    asked = F.col("id") % 20 == 0
    want = brute(rows, lambda i: i % 20 == 0)
    assert want and result(negatives.mine(frame(spark, rows), asked)) == want
    assert negatives.mine(frame(spark, rows).limit(0), asked).collect() == []
    assert negatives.mine(frame(spark, rows), F.col("id") == 999).collect() == []


def test_bands_near_the_ends(spark):
    xs = [0, 1, -1, 9, 10, 11, -9, -10, -11, ENDS[0], ENDS[1]]
    df = spark.createDataFrame([(x,) for x in xs], "score long")
    got = df.select("score", negatives._tenths(3, 9).alias("low"), negatives._tenths(9, 0).alias("high")).collect()
    assert [(r["low"], r["high"]) for r in got] == [(-((-3 * x) // 10), 9 * x // 10) for x in xs]
