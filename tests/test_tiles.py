"""Stored pairs are laid out by tile, and regions read only the tiles they meet."""

from __future__ import annotations

import pytest

from lacuna.sources import profiles
from lacuna.sources.profiles import TILE, Profile, in_regions, read_profile, read_profiles, write_profile


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tiles")
    paths = []
    for k in range(2):
        wins = [w // 256 * 256 for w in (0, 512, TILE - 300, TILE + 300, 3 * TILE, 7 * TILE + 5000)]
        pairs = [(c, w, f"s{k}", f"g{k}", 7, 3 + i) for c in ("chr1", "HLA:A*01") for i, w in enumerate(wins)]
        profile = Profile(
            spark.createDataFrame(pairs, profiles.PAIRS),
            spark.createDataFrame([(f"s{k}", f"g{k}", 300, 5)], profiles.HIST),
            spark.createDataFrame([(f"g{k}", f"s{k}", 300, 300.0, 20.0, 100, 200, 400, 1.0)], profiles.READ_GROUPS),
            spark.createDataFrame([("chr1", 0, 9 * TILE), ("HLA:A*01", 1, 9 * TILE)], profiles.CONTIGS),
        )
        paths.append(f"{folder}/p{k}")
        write_profile(profile, paths[-1])
    return paths


def files_read(df):
    """Files and rows of the scan, as its own counters say."""
    df = df.select("*")  # a plan that has not run: its counters are set once
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
    leaves = plan.collectLeaves()
    return [leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size())]


@pytest.mark.parametrize("many", [False, True])
def test_two_far_regions_read_their_tiles_only(spark, stored, many):
    pairs = read_profiles(spark, stored).pairs if many else read_profile(spark, stored[0]).pairs
    regions = spark.createDataFrame([("chr1", 600, 700), ("chr1", 7 * TILE + 5000, 7 * TILE + 5100)], "contig string, beg bigint, end bigint")
    got = pairs.where(in_regions(regions)).select("contig", "win", "sample")
    windows = (512, (7 * TILE + 5000) // 256 * 256)
    assert {tuple(r) for r in got.collect()} == {("chr1", w, f"s{k}") for w in windows for k in range(2 if many else 1)}
    assert files_read(got) == [4 if many else 2]


def test_a_region_over_a_border_meets_both_tiles(spark, stored):
    regions = spark.createDataFrame([("HLA:A*01", TILE - 400, TILE + 400)], "contig string, beg bigint, end bigint")
    got = read_profile(spark, stored[0]).pairs.where(in_regions(regions))
    assert sorted(r["win"] for r in got.collect()) == [(TILE - 300) // 256 * 256, (TILE + 300) // 256 * 256]


def test_no_region_gives_no_test(spark):
    none = spark.createDataFrame([], "contig string, beg bigint, end bigint")
    assert in_regions(none) is None


def test_the_test_is_bounded_by_tiles_not_by_regions(spark, stored):
    rows = [("chr1", 1000 * i, 1000 * i + 10) for i in range(3000)]
    regions = spark.createDataFrame(rows, "contig string, beg bigint, end bigint")
    assert str(in_regions(regions)).count("chr1") == 2


def test_a_dataset_without_tiles_is_read_by_window(spark, stored, tmp_path):
    pairs = read_profile(spark, stored[0]).pairs.drop("tile")
    pairs.write.partitionBy("contig").parquet(f"{tmp_path}/pairs")
    old = spark.read.schema(profiles.STORED_PAIRS).parquet(f"{tmp_path}/pairs")
    regions = spark.createDataFrame([("chr1", 600, 700)], "contig string, beg bigint, end bigint")
    assert [r["win"] for r in old.where(in_regions(regions)).collect()] == [512]
