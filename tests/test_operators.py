"""Operators against plain Python on small random input."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.functions import genotype as G
from lacuna.functions import reads as R
from lacuna.functions import regions, text
from lacuna.operators import intervals, merging, scan, windows
from lacuna.params import CallParams, ParameterError, ProfileParams, ReadQuality, ViewParams
from lacuna.streaming import admission


def test_activity_on_the_grid(spark):
    rng = random.Random(1)
    pairs = [("c", 0, "g", rng.randint(0, 900)) for _ in range(80)]
    pairs = [(*p, p[3] + rng.choice([0, 5, 70, 400])) for p in pairs]
    df = spark.createDataFrame(pairs, "contig string, sample int, rg string, start bigint, end_pos bigint").withColumns(
        {"last_win": windows.grid_bin(F.col("end_pos")), "dev": F.lit(0)}
    )
    got = {(r["p"], r["n"]) for r in windows.active_pairs(df).groupBy("p").agg(F.count("*").alias("n")).collect()}
    want = set()
    for p in range(0, 1500, 30):
        n = sum(s <= p <= e // 30 * 30 + 30 for *_, s, e in pairs)
        if n:
            want.add((p, n))
    assert got == want


def test_candidate_chains(spark):
    rng = random.Random(2)
    rows = [(p, rng.randint(-60, 400), rng.choice([20, 60])) for p in range(40) for _ in range(rng.randint(1, 6))]
    df = spark.createDataFrame([("c", *r) for r in rows], "contig string, p bigint, q3 bigint, threshold bigint")
    got = {(r["p"], r["len0"]) for r in windows.candidate_lengths(df).collect()}
    want = set()
    for p in range(40):
        mine = sorted((q, t) for pp, q, t in rows if pp == p)
        chains = [[mine[0]]]
        for a, b in zip(mine, mine[1:], strict=False):
            if b[0] - a[0] < 50:
                chains[-1].append(b)
            else:
                chains.append([b])
        for chain in chains:
            mean = int(sum(q for q, _ in chain) / len(chain))
            if mean > min(t for _, t in chain):
                want.add((p, mean))
    assert got == want


@pytest.mark.parametrize("gap", [0, 7])
def test_merge_intervals_with_tiles(spark, gap):
    rng = random.Random(gap)
    rows = [(c, b, b + rng.randint(1, 60)) for c in "ab" for b in (rng.randint(0, 5000) for _ in range(150))]
    df = spark.createDataFrame(rows, "contig string, beg bigint, end bigint")
    got = {(r["contig"], r["beg"], r["end"]) for r in intervals.merge_intervals(df, gap, tile=100).collect()}
    want = []
    for c, b, e in sorted(rows):
        if want and want[-1][0] == c and want[-1][2] + gap >= b:
            want[-1] = (c, want[-1][1], max(e, want[-1][2]))
        else:
            want.append((c, b, e))
    assert got == set(want)


def test_running_max_ignores_tile_size(spark):
    rng = random.Random(5)
    rows = [("k", i, rng.randint(0, 99)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, pos bigint, v bigint")
    for tile in (7, 10_000):
        out = scan.running_max(df, ["k"], "pos", F.col("v"), [F.col("pos")], tile, "m").orderBy("pos").collect()
        assert [r["m"] for r in out] == [None] + [max(v for *_, v in rows[:i]) for i in range(1, 300)]


@pytest.mark.parametrize("tile", [60, 900, 90_000])
def test_admission_matches_one_ordered_pass(spark, tile):
    rng = random.Random(9)
    rows = []
    for rg in ("x", "y"):
        for i in range(300):
            start = rng.randint(0, 4000)
            end = start + rng.randint(0, 200)
            rows.append(("c", "s", rg, start, i, end, end // 30 * 30))
    schema = "contig string, sample string, rg string, start bigint, dev bigint, end_pos bigint, last_win bigint"
    got = {(r["rg"], r["dev"]) for r in admission.admitted_pairs(spark.createDataFrame(rows, schema), None, 6, tile).collect()}
    want = set()
    for rg in ("x", "y"):
        opened: list[int] = []
        for r in sorted((r for r in rows if r[2] == rg), key=lambda r: (r[3], r[4])):
            opened = [w for w in opened if w >= r[3] // 30 * 30]
            if len(opened) < 6:
                opened.append(r[6])
                want.add((rg, r[4]))
    assert got == want and len(want) < len(rows)


def test_admission_on_a_stream(spark, tmp_path):
    rows = [("c", "g", s, 0, s // 30 * 30 + 60) for s in range(0, 600, 5)]
    schema = "contig string, rg string, start bigint, dev bigint, last_win bigint"
    for i in range(3):
        part = spark.createDataFrame(rows[i * 40 : (i + 1) * 40], schema)
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = admission.admit_stream(stream, 4).writeStream.format("memory").queryName("admitted").option(
        "checkpointLocation", str(tmp_path / "ck")
    ).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(r["start"] for r in spark.table("admitted").collect())
    opened: list[int] = []
    assert got == [s for _, _, s, _, w in rows if admission.admit(opened, s, w, 4)]


def test_clustering_rules():
    def joins(head, call, sigma=0.0):
        overlaps, continues = merging._against(head, *(np.array([x]) for x in call), sigma)
        return bool(overlaps[0]), bool(continues[0])

    same = (0, 100, 100)
    assert joins(same, (0, 199, 199))[0] and joins(same, (0, 201, 201)) == (False, False)
    assert joins(same, (0, 201, 201), 51)[0]
    assert joins(same, (75, 175, 100)) == (True, False) and joins(same, (90, 190, 100)) == (False, False)
    assert joins((0, 10, 500), (100, 120, 500), 1.0) == (False, True)
    pos, end, length = (np.array(x) for x in ([0, 5, 1000, 5000, 5010], [90, 95, 1100, 5600, 5600], [100, 90, 100, 600, 610]))
    ids = merging.cluster_ids(pos, end, length, [True] * 5, 1.0, False)
    assert ids.tolist() == [0, 0, -1, 2, 2]
    assert merging.cluster_ids(pos, end, length, [False, True, True, True, True], 1.0, False).tolist() == [-1, -1, -1, 2, 2]
    assert merging.cluster_ids(np.array([1]), np.array([2]), np.array([3]), [True], 1.0, False).tolist() == [-1]


def test_averaged_phred_ties(spark):
    rows = [(0, 10, 10, 2), (4, 0, 4, 2), (9, 9, 0, 3), (0, 0, 30, 2), (1, 0, 30, 4), (0, 1, 30, 4), (0, 0, 0, 1)]
    df = spark.createDataFrame(rows, "a bigint, b bigint, c bigint, n bigint")
    out = [tuple(r) for r in df.select(*merging.averaged_phred([F.col(x) for x in "abc"], F.col("n"))).collect()]
    assert out == [(0, 5, 6), (2, 0, 2), (3, 4, 0), (0, 1, 15), (1, 0, 8), (0, 1, 8), (0, 0, 1)]


def test_regions(spark):
    rows = ["chr1", "chr1:1000", "chr1:1,000-2000", "HLA-A*01:01", "chr1:", "", "chr1:0-5", "a:b:5-10", "a:b", "chr1:5-x"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    got = [r["r"] and tuple(r["r"]) for r in df.orderBy("i").select(regions.parse_region(F.col("t")).alias("r")).collect()]
    assert got == [
        ("chr1", None, None), ("chr1", 999, None), ("chr1", 999, 2000), ("HLA-A*01", 0, None), None, None, None,
        ("a:b", 4, 10), ("a:b", None, None), None,
    ]
    with pytest.raises(Exception, match="invalid genomic region"):
        intervals.parse_regions(df.selectExpr("t AS value").where("value = 'chr1:'")).collect()


def test_cigars(spark):
    rows = ["100M", "10S90M", "90M10S", "5H95M", "50M1000D50M", "30M2I68M", "40M5P60M", "5H90M3S"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string").withColumn("c", R.parse_cigar(F.col("t")))
    got = df.orderBy("i").select(
        R.reference_length(F.col("c")), R.left_clip(F.col("c")), R.right_clip(F.col("c")), R.read_length(F.lit(95), F.col("c"))
    ).collect()
    assert [tuple(r) for r in got] == [
        (100, 0, 0, 95), (90, 10, 0, 95), (90, 0, 10, 95), (95, 0, 0, 195), (1100, 0, 0, 95), (98, 0, 0, 95),
        (105, 0, 0, 95), (90, 0, 3, 103),
    ]


def test_flag_masks():
    q = ReadQuality()
    assert (q.forward().flags_set, q.forward().flags_unset) == (33, 3868)
    assert (q.reverse().flags_set, q.reverse().flags_unset) == (17, 3884)


def test_likelihood_ladder():
    keys = G.likelihood_ladder()
    assert len(keys) == 101 and keys == sorted(keys)
    assert keys[20] == pytest.approx(6.63489660102121 / 2 + 9.21024036697585, rel=1e-9)


def test_parameters():
    assert CallParams().min_likelihood_ratio == pytest.approx(12.5277, abs=1e-4)
    assert CallParams(max_load=0).load_limit > 10**9
    for bad in (dict(segment_size=10), dict(pseudocount_fraction=10), dict(min_rel_window_cover=3.0), dict(min_sample_fraction=2.0)):
        with pytest.raises(ParameterError):
            CallParams(**bad)
    with pytest.raises(ParameterError):
        ProfileParams(reference="hg7")
    for bad in (dict(chunk_size=10), dict(padding=5, out="x")):
        with pytest.raises(ParameterError):
            ViewParams(**bad)


def test_header_and_names(spark):
    lines = text.vcf_header([("chr1", 10)], ["a", "b"], "20240101")
    assert lines[0] == "##fileformat=VCFv4.3" and lines[-1].endswith("FORMAT\ta\tb")
    df = spark.createDataFrame([("/x/y/s1.bam",), ("s2.profile",), ("/x.d/s3",)], "p string")
    assert [r[0] for r in df.select(regions.sample_name(F.col("p"))).collect()] == ["s1", "s2", "s3"]
