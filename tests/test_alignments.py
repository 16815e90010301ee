"""The BAM source against a plain decoder: columns, ranges, regions, pushed filters, and what is read for them."""

from __future__ import annotations

import io
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lacuna.params import ParameterError
from lacuna.sources import alignments as A
from lacuna.sources import bam_index, bam_records
from tests import bam_files as B

CONTIGS = [("chr1", 1_000_000), ("chr2", 300_000), ("empty", 1000), ("chr3", 90_000)]
FIELDS = "contig pos mapq flag l_seq mate_contig mate_pos tlen cigar qname rg as_score".split()


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bam") / "x.bam")
    records = B.random_records(3000, [1_000_000, 300_000, 1, 90_000])
    records = [r for r in records if r[4:8] != b"\2\0\0\0"]  # nothing on the third contig
    B.write_bam(path, records, CONTIGS, b"@HD\tVN:1.6\n@RG\tID:g1\tSM:x\n@RG\tID:g2\n")
    return path


def rows(df):
    return sorted((tuple([tuple(c) for c in x] if isinstance(x, list) else x for x in (r[f] for f in FIELDS)) for r in df.collect()), key=repr)


def overlapping(row, beg, end):
    span = max(1, sum(n for op, n in row[8] if op in "MDN=X"))
    return row[1] < end and row[1] + span > beg


def test_every_record(spark, path):
    want = sorted(B.plain_rows(path), key=repr)
    assert len(A.plan_ranges(path, 1)) > 20
    for size in (1, 5000, A.RANGE_BYTES):
        assert rows(A.read_bam(spark, path, range_bytes=size)) == want
    assert {r["sample"] for r in A.read_bam(spark, path).select("sample").distinct().collect()} == {"x"}
    assert rows(A.read_bam(spark, f"file://{path}").limit(10_000)) == want


@pytest.mark.parametrize("window", [1, 700, 1 << 20])
def test_stretches(path, window):
    """The same records from stretches of any size and from every known start."""
    want = B.plain_rows(path)
    first = A.read_header(path)[2]
    contigs = pa.array([c for c, _ in CONTIGS])

    def decoded(begin, end):
        with open(path, "rb") as f:
            found = [bam_records.decode("p", d, s, contigs, lambda h, c: None) for d, s in bam_records.stretches(f, begin, end, window)]
        return [r["qname"] for b in found for r in b.to_pylist()]

    names = [r[9] for r in want]
    assert decoded(first, bam_index.END) == names
    starts = sorted({x for one in A.read_index(path) for x in one.starts()})
    for cut in random.Random(2).sample(starts, 12):
        assert decoded(first, cut) + decoded(cut, bam_index.END) == names


def test_regions(spark, path):
    every = B.plain_rows(path)
    rng = random.Random(3)
    for _ in range(6):
        regions = [(c, at, at + rng.choice([1, 500, 40_000])) for c, n in rng.choices(CONTIGS, k=4) for at in [rng.randrange(n)]]
        want = sorted((r for r in every if any(r[0] == c and overlapping(r, b, e) for c, b, e in regions)), key=repr)
        assert rows(A.read_bam(spark, path, range_bytes=2000, regions=regions)) == want
    assert rows(A.read_bam(spark, path, regions=[])) == []
    assert rows(A.read_bam(spark, path, ["chr2", "unknown"])) == sorted((r for r in every if r[0] == "chr2"), key=repr)
    assert rows(A.read_bam(spark, path, ["chr1"], regions=[("chr1", 5, 900), ("chr3", 0, 90_000)])) == sorted(
        (r for r in every if r[0] == "chr1" and overlapping(r, 5, 900)), key=repr
    )


@pytest.mark.parametrize("text, keep", [
    ("contig = 'chr2'", lambda r: r[0] == "chr2"),
    ("contig in ('chr2', 'chr3') and pos >= 70000", lambda r: r[0] in ("chr2", "chr3") and r[1] >= 70_000),
    ("contig = 'chr1' and pos > 500000 and pos < 510000", lambda r: r[0] == "chr1" and 500_000 < r[1] < 510_000),
    ("pos <= 1000", lambda r: r[1] <= 1000),
    ("pos = 77 or contig is null", lambda r: r[1] == 77 or r[0] is None),
    ("contig = 'chr1' and pos > 9 and pos < 5", lambda r: False),
])
def test_pushed_filters(spark, path, text, keep):
    want = sorted((r for r in B.plain_rows(path) if keep(r)), key=repr)
    assert rows(A.read_bam(spark, path, range_bytes=2000).where(text)) == want


def test_only_overlapping_ranges_are_read(path, monkeypatch):
    """Ranges and bytes that are read for a region, against the whole file."""
    monkeypatch.setattr(bam_index, "NEAR", 100)
    whole = A.plan_ranges(path, 1)
    one = A.plan_ranges(path, 1, A.Wanted(regions={"chr1": [(500_000, 501_000)]}))
    assert 0 < len(one) < len(whole) / 5
    two = A.plan_ranges(path, 1, A.Wanted(regions={"chr1": [(0, 1000), (999_000, 1_000_000)]}))
    assert 0 < len(two) < len(whole) / 3
    assert A.plan_ranges(path, 1, A.Wanted(contigs={"empty"})) == A.plan_ranges(path, 1, A.Wanted(low=5, high=5)) == []

    class Counted(io.FileIO):
        taken = 0

        def read(self, n=-1):
            Counted.taken += n
            return super().read(n)

    with Counted(path) as f:
        for r in one:
            for _ in bam_records.stretches(f, r.begin, r.end, 1 << 20):
                pass
        assert Counted.taken < f.seek(0, 2) / 3


def test_pushdown_reaches_the_reader(path):
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

    reader = A.BamReader({"paths": f'["{path}"]', "rangebytes": "1"})
    filters = [EqualTo(("contig",), "chr1"), GreaterThanOrEqual(("pos",), 500_000), LessThan(("pos",), 501_000), In(("rg",), ["a"])]
    assert list(reader.pushFilters(filters)) == filters
    assert 0 < len(reader.partitions()) < len(A.plan_ranges(path, 1)) / 5


def test_header(spark, path, tmp_path):
    assert [tuple(c) for c in A.bam_contigs(spark, path).collect()] == [(c, i, n) for i, (c, n) in enumerate(CONTIGS)]
    assert [c["rg"] for c in A.bam_read_groups(spark, path).collect()] == ["g1", "g2"]
    bare = str(tmp_path / "bare.bam")
    B.write_bam(bare, [], CONTIGS)
    assert A.read_bam(spark, bare).count() == 0
    (tmp_path / "bare.bam.bai").rename(tmp_path / "other")
    with pytest.raises(ParameterError, match="index"):
        A.plan_ranges(bare, 1)


def test_damaged_records():
    bad = B.record("q", 0, 5, tags=b"XX?\1")
    with pytest.raises(ValueError, match="tag"):
        bam_records.decode("p", bad, bam_records.boundaries(bad, None)[0], pa.array(["c"]), lambda h, c: None)
    assert bam_records.boundaries(bad + bad[:20], None)[1] == len(bad)


def test_several_files(spark, path, tmp_path):
    other = str(tmp_path / "y.bam")
    B.write_bam(other, B.random_records(200, [1_000_000, 300_000], 9), CONTIGS)
    both = A.read_bam(spark, [path, other], regions=[("chr1", 0, 400_000)])
    count = {r["sample"]: r["count"] for r in both.groupBy("sample").count().collect()}
    assert count == {s: sum(r[0] == "chr1" and overlapping(r, 0, 400_000) for r in B.plain_rows(p)) for s, p in (("x", path), ("y", other))}
    assert both.where(F.col("contig") != "chr1").count() == 0
