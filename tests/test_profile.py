"""Alignment records to profiles, their storage and their views."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.cli import call_params, parser
from lacuna.params import ParameterError, ProfileParams, ViewParams
from lacuna.plans import view
from lacuna.plans.profile import build_profile
from lacuna.sources import profiles as P

LENGTH = 20_000


def records(spark, n=4_000, seed=4):
    """Proper pairs of two samples with 100-base reads, some of them clipped or low quality."""
    rng = np.random.default_rng(seed)
    rows, truth = [], []
    for s in ("a", "b"):
        for i in range(n):
            pos, size = int(rng.integers(0, LENGTH - 800)), int(round(rng.normal(350, 30)))
            mapq = 0 if rng.random() < 0.05 else 60
            clip = 10 if rng.random() < 0.1 else 0
            mate = pos + size - 100
            cigar = [("S", clip), ("M", 100 - clip)] if clip else [("M", 100)]
            rows.append((s, "chr1", pos + clip, mapq, 99, 100, "chr1", mate, size, cigar, f"q{i}", f"{s}1", 100))
            rows.append((s, "chr1", mate, 60, 147, 100, "chr1", pos + clip, -size, [("M", 100)], f"q{i}", f"{s}1", 100))
            if mapq:
                truth.append((f"{s}1", pos + 100, size))
    contigs = spark.createDataFrame([("chr1", 0, LENGTH)], P.CONTIGS)
    return spark.createDataFrame(rows, P.READS), contigs, truth


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    reads, contigs, truth = records(spark)
    sampling = spark.createDataFrame([("chr1:1-15000",)], "value string")
    profile = build_profile(reads, contigs, ProfileParams(min_pairs=500), sampling=sampling)
    path = str(tmp_path_factory.mktemp("profile") / "p")
    P.write_profile(profile, path)
    return P.read_profile(spark, path), truth, path


def test_pairs_and_statistics(stored):
    profile, truth, _ = stored
    stats = {r["rg"]: r for r in profile.read_groups.collect()}
    assert set(stats) == {"a1", "b1"}
    for r in stats.values():
        assert abs(r["median"] - 350) <= 3 and abs(r["stddev"] - 30) < 3 and r["read_len"] == 100
        assert r["coverage"] > 5 and r["lo"] < r["median"] < r["hi"]
    got = sorted((r["rg"], r["win"] + r["off"], r["dev"] + stats[r["rg"]]["median"]) for r in profile.pairs.collect())
    assert got == sorted(truth)


def test_scan_is_pruned(stored):
    profile, _, _ = stored
    plan = profile.pairs.where("contig = 'chr1' AND win BETWEEN 512 AND 1024").select("dev")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(contig" in plan and "GreaterThanOrEqual(win,512)" in plan
    assert "ReadSchema: struct<win:bigint,dev:bigint>" in plan


def test_too_few_pairs(spark):
    reads, contigs, _ = records(spark, n=50)
    sampling = spark.createDataFrame([("chr1",)], "value string")
    with pytest.raises(ParameterError, match="not enough read pairs"):
        build_profile(reads, contigs, ProfileParams(), sampling=sampling)
    with pytest.raises(ParameterError, match="default sampling"):
        build_profile(reads, contigs.withColumnRenamed("contig", "x").selectExpr("'zz' AS contig", "contig_id", "len"), ProfileParams())


def test_views(stored, spark):
    profile, truth, _ = stored
    assert view.header(profile) == ["@HD\tVN:0.1", "@RG\tID:a1", "@RG\tID:b1", "@SQ\tSN:chr1\tLN:20000"]
    lines = {r["win"]: r["line"] for r in view.window_text(profile, "chr1:1000-3000").collect()}
    assert set(lines) <= set(range(1024, 3000, 256)) and lines
    cells = lines[1024].split("\t")
    assert cells[:2] == ["chr1", "1025"] and len(cells) == 4
    shown = sum(0 if c == "." else c.count(",") + 1 for c in cells[2:])
    assert shown == sum(1024 <= start < 1280 for _, start, _ in truth)
    head, rows = view.histogram_text(profile)
    assert [h.split("\t")[0] for h in head] == ["#RG", "#Median", "#Std_dev", "#Read_length", "INSERT_SIZE"]
    assert rows.count() > 100


def test_chunks(stored, spark, tmp_path):
    profile, truth, _ = stored
    parts = view.chunk_pairs(profile, "o", 5_000, 600).groupBy("file").count().collect()
    got = {r["file"]: r["count"] for r in parts}
    for beg in range(0, LENGTH, 5_000):
        end = min(beg + 5_600, LENGTH)
        assert got[f"o.chr1.{beg}-{end}.profile"] == sum(beg <= s // 256 * 256 < end for _, s, _ in truth)
    view.write_chunks(profile, ViewParams(out=str(tmp_path / "c"), chunk_size=5_000, padding=600))
    assert spark.read.parquet(str(tmp_path / "c" / "pairs")).count() == sum(got.values())
    view.write_chunks(profile, ViewParams(out=str(tmp_path / "w"), region="chr1:1-5000"))
    assert P.read_profile(spark, str(tmp_path / "w")).pairs.count() == sum(s // 256 * 256 < 5_000 for _, s, _ in truth)


def test_several_datasets_and_read_group_names(stored, spark):
    profile, truth, path = stored
    both = P.read_profiles(spark, [path, path])
    assert both.pairs.count() == 2 * len(truth)
    assert {r["contig"] for r in both.pairs.select("contig").distinct().collect()} == {"chr1"}
    P.check_read_groups(profile)
    renamed = P.per_sample_read_groups(profile)
    assert {r["rg"] for r in renamed.read_groups.collect()} == {"a:a1", "b:b1"}


def test_shared_identifiers_give_the_same_profile_and_calls(spark):
    """Two samples that both use read group 1 against the same samples with names of their own."""
    reads, contigs, _ = records(spark)
    sampling = spark.createDataFrame([("chr1:1-15000",)], "value string")
    shared = reads.withColumn("rg", F.lit("1"))
    made = {}
    for name, rows in (("own", reads), ("shared", shared)):
        profile = build_profile(rows, contigs, ProfileParams(min_pairs=500), sampling=sampling)
        pairs = sorted(tuple(r) for r in profile.pairs.drop("rg").collect())
        hist = sorted(tuple(r) for r in profile.hist.drop("rg").collect())
        stats = sorted(tuple(r) for r in profile.read_groups.drop("rg").collect())
        made[name] = pairs, hist, stats
        assert {r["rg"] for r in profile.read_groups.collect()} == ({"a1", "b1"} if name == "own" else {"1"})
    assert made["own"] == made["shared"]


def test_a_sample_is_stored_once(stored, spark, tmp_path):
    profile, _, path = stored
    with pytest.raises(ParameterError, match="in this profile already"):
        P.write_profile(profile, path)
    with pytest.raises(ParameterError, match="more than once"):
        P.check_read_groups(P.read_profiles(spark, [path, path]))
    other = P.Profile(*[t.withColumn("sample", F.concat(F.lit("x"), "sample")) if "sample" in t.columns else t
                        for t in (profile.pairs, profile.hist, profile.read_groups, profile.contigs)])
    P.write_profile(profile, str(tmp_path / "p"))
    P.write_profile(other, str(tmp_path / "p"))
    both = P.read_profile(spark, str(tmp_path / "p"))
    assert both.pairs.count() == 2 * profile.pairs.count()
    with pytest.raises(ParameterError, match="per_sample_rg"):
        P.check_read_groups(both)
    P.check_read_groups(P.per_sample_read_groups(both))


def test_text_inputs(spark, tmp_path):
    (tmp_path / "l.txt").write_text("x.p y.p\nx.p\n z.p\n")
    assert P.profile_list(spark, str(tmp_path / "l.txt")) == ["x.p", "y.p", "z.p"]
    (tmp_path / "load.txt").write_text("g1 7\ng2\t0\n")
    limits = {r["rg"]: r["max_load"] for r in P.load_limits(spark, str(tmp_path / "load.txt")).collect()}
    assert limits == {"g1": 7, "g2": 2**31 - 1}


def test_options():
    a = parser().parse_args(["call", "p1", "p2", "-s", "0.2", "-r", "chr1", "-r", "chr2:5-9", "-n", "-b", "20000"])
    params = call_params(a)
    assert params.window_wise and params.min_sample_fraction == 0.2 and a.region_of_interest == ["chr1", "chr2:5-9"]


def test_profiles_of_other_references(spark, stored, tmp_path):
    """Datasets are read together only if their contigs agree in name, place and length."""
    profile, _, path = stored
    same, other = str(tmp_path / "same"), str(tmp_path / "other")
    P.write_profile(profile, same)
    assert P.read_profiles(spark, [path, same]).read_groups.count() == 2 * profile.read_groups.count()
    longer = profile.contigs.withColumn("len", F.col("len") + 1)
    P.write_profile(P.Profile(profile.pairs, profile.hist, profile.read_groups, longer), other)
    with pytest.raises(ParameterError, match="different contigs"):
        P.read_profiles(spark, [path, same, other])
