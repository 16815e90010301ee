"""Profiles of BAM files: regions and sampling rounds read less and give the same as the whole files."""

from __future__ import annotations

from functools import partial

import pytest
from pyspark.sql import functions as F

from lacuna import cli
from lacuna.params import ParameterError, ProfileParams
from lacuna.plans.profile import build_profile
from lacuna.sources import alignments as A
from lacuna.sources import profiles as P
from tests import bam_files as B
from tests.test_profile import records

CONTIGS = [("chr1", 20_000)]


@pytest.fixture(scope="module")
def paths(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("bams")
    reads, _, _ = records(spark, n=2500)
    out = []
    for s in ("a", "b"):
        rows = reads.where(F.col("sample") == s).orderBy("pos").collect()
        made = [
            B.record(r["qname"], 0, r["pos"], r["flag"], [tuple(c) for c in r["cigar"]], (0, r["mate_pos"]), r["tlen"], r["mapq"], B.group(r["rg"], r["as_score"]), r["l_seq"])
            for r in rows
        ]
        out.append(str(folder / f"{s}.bam"))
        B.write_bam(out[-1], made, CONTIGS, f"@RG\tID:{s}1\tSM:{s}\n".encode())
    return out


def content(profile):
    pairs = profile.pairs.select("sample", "rg", "contig", "win", "off", "dev")
    return [sorted((tuple(r) for r in df.collect()), key=repr) for df in (pairs, profile.hist.select("sample", "rg", "size", "cnt"), profile.read_groups)]


SAMPLING = [f"chr1:{1 + 1500 * k}-{1000 + 1500 * k}" for k in range(12)]


@pytest.mark.parametrize("regions, merged", [(None, True), (["chr1:4000-9000", "chr1:15000-15500"], False)])
def test_same_profile(spark, paths, regions, merged):
    params = ProfileParams(min_pairs=300, merge_read_groups=merged, max_deletion=1000)
    rois = spark.createDataFrame([(r,) for r in regions], "value string") if regions else None
    sampling = spark.createDataFrame([(s,) for s in SAMPLING], "value string")
    contigs, groups = A.bam_contigs(spark, paths), A.bam_read_groups(spark, paths)
    asked = []

    def within(wanted, samples):
        asked.append((len(wanted), samples))
        return A.read_regions(spark, paths, wanted, samples)

    every = A.read_bam(spark, paths)
    want = build_profile(every, contigs, params, rois, sampling, groups)
    got = build_profile(every, contigs, params, rois, sampling, groups, within)
    assert content(got) == content(want) and want.pairs.count() > 100
    rounds = asked[:-1] if regions else asked
    assert sum(n for n, _ in rounds) < len(SAMPLING)  # what lies behind the stop is never read
    assert [n for n, _ in rounds] == [1, 2, 4][: len(rounds)] and rounds[0][1] is None


def test_only_short_samples_go_on(spark, paths):
    """A sample that has enough is not read again."""
    params = ProfileParams(min_pairs=200)
    contigs, groups = A.bam_contigs(spark, paths), A.bam_read_groups(spark, paths)
    sampling = spark.createDataFrame([(s,) for s in SAMPLING], "value string")
    asked = []

    def within(wanted, samples):
        asked.append(samples)
        rows = A.read_regions(spark, paths, wanted, samples)
        return rows.where("sample <> 'b' OR pos % 3 = 0")  # b is three times as shallow

    build_profile(A.read_bam(spark, paths), contigs, params, None, sampling, groups, within)
    assert asked[0] is None and asked[-1] == ["b"]


def test_too_few(spark, paths):
    contigs, groups = A.bam_contigs(spark, paths), A.bam_read_groups(spark, paths)
    sampling = spark.createDataFrame([(s,) for s in SAMPLING[:2]], "value string")
    with pytest.raises(ParameterError, match="not enough"):
        build_profile(A.read_bam(spark, paths), contigs, ProfileParams(), None, sampling, groups, partial(A.read_regions, spark, paths))


def test_command(spark, paths, tmp_path, capsys):
    (tmp_path / "list.txt").write_text("\n".join([*paths, paths[0]]))
    (tmp_path / "sampling.txt").write_text(" ".join(SAMPLING))
    out = str(tmp_path / "p")
    assert cli.main(["profile", str(tmp_path / "list.txt"), "-i", str(tmp_path / "sampling.txt"), "-n", "300", "-o", out]) == 0, capsys.readouterr().err
    spark = cli.SparkSession.builder.getOrCreate()
    assert {r["rg"] for r in P.read_profile(spark, out).read_groups.collect()} == {"a1", "b1"}


def test_other_reference(spark, paths, tmp_path):
    other = str(tmp_path / "c.bam")
    B.write_bam(other, [], [("chr1", 999)])
    with pytest.raises(ParameterError, match="contigs"):
        A.bam_contigs(spark, [paths[0], other])
