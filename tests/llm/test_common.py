"""Slices, components and staged tables."""

import random

import pyarrow as pa

from lacuna.llm import common
from lacuna.session import remove_run_folder, run_folder


def test_slices_keep_rows_and_bound_bytes():
    texts = ["x" * n for n in (0, 5, 100, 3, 3, 3, 40, 0)] + [None]
    batch = pa.record_batch({"id": pa.array(range(9)), "text": pa.array(texts)})
    got = list(common.slices([batch, batch.slice(0, 0)], most_bytes=10))
    assert [r for b in got for r in b.column("text").to_pylist()] == texts
    assert all(b.num_rows == 1 or sum(len(t or "") for t in b.column("text").to_pylist()) <= 10 for b in got)


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2200)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert common.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_run_folder_goes(spark):
    staged = common.stage(spark.range(3), "x")
    assert staged.count() == 3
    path = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    assert system.exists(path)
    remove_run_folder(spark)
    assert not system.exists(path)
