"""Planted deletions through the whole call command."""

import pytest
from pyspark.sql import functions as F

from lacuna.operators import genotyping, merging
from lacuna.params import CallParams
from lacuna.plans.call import call_deletions, vcf_records
from lacuna.sources.profiles import Profile
from tests.simulate import cohort

PLANTED = [
    (12_000, 600, {0: 1, 1: 2}),
    (25_000, 1_000, {2: 1, 3: 1, 4: 2}),
    (40_000, 2_000, {5: 2, 0: 1}),
]


@pytest.fixture(scope="module")
def profile(spark):
    return cohort(spark, PLANTED)


@pytest.fixture(scope="module")
def result(profile):
    return call_deletions(profile, CallParams())


def test_planted_deletions_are_found(result):
    calls = sorted(result.calls.collect(), key=lambda r: r["pos"])
    assert len(calls) == len(PLANTED)
    for call, (pos, length, carriers) in zip(calls, PLANTED, strict=True):
        assert abs(call["pos"] - pos) <= 120
        assert abs(call["len"] - length) <= 40
        assert call["af"] == pytest.approx(sum(carriers.values()) / 12)
        assert call["sig_windows"] >= 2 and call["filter"] == 0


def test_genotypes_match(result):
    calls = {(r["contig"], r["segment"], r["cluster"]): r["pos"] for r in result.calls.collect()}
    seen = {}
    for r in result.samples.collect():
        pos = calls.get((r["contig"], r["segment"], r["cluster"]))
        if pos is not None:
            pl = [r["pl0"], r["pl1"], r["pl2"]]
            assert min(pl) == 0
            seen[min(range(len(PLANTED)), key=lambda i: abs(PLANTED[i][0] - pos)), r["sample"]] = pl.index(0)
    for i, (_, _, carriers) in enumerate(PLANTED):
        for s in range(6):
            assert seen[i, f"s{s}"] == carriers.get(s, 0)


def test_records(result):
    lines = [r["line"].split("\t") for r in vcf_records(result).collect()]
    assert len(lines) == len(PLANTED)
    for cells in lines:
        assert len(cells) == 9 + 6
        assert cells[3:5] == ["N", "<DEL>"] and cells[6] == "PASS"
        assert cells[9].count(":") == 6


def test_depth_classes_sum_to_usable_pairs(profile):
    rows = call_deletions(profile, CallParams(window_wise=True)).samples.collect()
    assert rows
    for r in rows:
        lad = r["lad_ref"] + r["lad_amb"] + r["lad_del"]
        dad = sum(r[c] for c in genotyping.COUNTS[3:])
        assert lad == dad


def test_region_of_interest(spark, profile):
    roi = spark.createDataFrame([("chr1:20,001-35000",)], "value string")
    calls = call_deletions(profile, CallParams(), roi).calls.collect()
    assert [abs(r["pos"] - 25_000) <= 120 for r in calls] == [True]


def test_strict_parity_and_load_limit(spark, profile):
    deep = spark.createDataFrame([("rg0", 5)], "rg string, max_load bigint")
    result = call_deletions(profile, CallParams(strict_parity=True), max_load=deep)
    assert result.calls.count() >= 2


def test_shared_identifiers(spark, profile, result):
    """Samples that all use one identifier give the same calls as samples with names of their own."""
    one = Profile(*[t.withColumn("rg", F.lit("1")) if "rg" in t.columns else t
                    for t in (profile.pairs, profile.hist, profile.read_groups, profile.contigs)])
    again = call_deletions(one, CallParams(per_sample_rg=True))
    lines = lambda x: sorted(r["line"] for r in vcf_records(x).collect())
    assert lines(again) == lines(result)


def test_merge_output_has_partners(result):
    assert all(r["sig_windows"] >= 1 for r in result.calls.collect())
    assert merging.CALL == ["contig", "segment", "cluster"]
