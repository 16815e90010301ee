"""Trimming of histograms against a plain loop, and the variant writer."""

from __future__ import annotations

import math
import random

from lacuna.operators import genotyping, histograms
from lacuna.sources.variants import write_vcf


def plain_trim(counts: dict[int, int], slots: int):
    lo, hi = 1, slots - 1
    while True:
        values = sorted(s for s, c in counts.items() if lo <= s < hi for _ in range(c))
        n = len(values)
        mean = sum(values) / n
        sd = math.sqrt(sum((v - mean) ** 2 for v in values) / (n - 1))
        median = values[(n + 1) // 2 - 1]
        new = max(1, math.floor(median - 3 * sd)), min(slots - 1, math.ceil(median + 3 * sd) + 1)
        if new == (lo, hi):
            return lo, hi, median
        lo, hi = new


def test_trimming(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for g in "ab":
        counts: dict[int, int] = {}
        for _ in range(3000):
            size = round(rng.gauss(350, 30)) if rng.random() < 0.95 else rng.randint(1, 1999)
            counts[size] = counts.get(size, 0) + 1
        want[g] = plain_trim(counts, 2000)
        rows += [(g, s, c) for s, c in counts.items()]
    out = histograms.trimmed_stats(spark.createDataFrame(rows, "rg string, size bigint, cnt bigint"), 2000)
    assert {r["rg"]: (r["lo"], r["hi"], r["median"]) for r in out.collect()} == want


def test_variant_file(spark, tmp_path):
    contigs = spark.createDataFrame([("chr2", 0, 90), ("chr1", 1, 80)], "contig string, contig_id bigint, len bigint")
    order = genotyping.sample_order(spark.createDataFrame([("s2",), ("s1",)], "sample string"))
    lines = spark.createDataFrame(
        [("chr1", 5, 9, "c"), ("chr2", 7, 9, "b"), ("chr2", 3, 9, "a")], "contig string, pos bigint, len bigint, line string"
    )
    path = str(tmp_path / "v")
    write_vcf(lines, contigs, order, path, parts=True)
    head = [r["value"] for r in spark.read.text(f"{path}/header").collect()]
    assert head[0] == "##fileformat=VCFv4.3" and head[-1].endswith("FORMAT\ts1\ts2")
    assert head.index("##contig=<ID=chr2,length=90>") < head.index("##contig=<ID=chr1,length=80>")
    parts = sorted((tmp_path / "v" / "records").glob("part-*"))
    assert "".join(p.read_text() for p in parts).split() == ["a", "b", "c"]
    one = str(tmp_path / "calls.vcf")
    write_vcf(lines, contigs, order, one)
    text = (tmp_path / "calls.vcf").read_text().splitlines()
    assert text == [*head, "a", "b", "c"]
