"""Seeded read pairs with planted deletions."""

from __future__ import annotations

import numpy as np
import pandas as pd

from lacuna.sources.profiles import Profile

READ_LEN = 100
MEAN, SD = 350, 40


def _haplotype(rng, length: int, n: int, deletions: list[tuple[int, int]]) -> pd.DataFrame:
    """Pairs of one haplotype in reference coordinates."""
    removed = sum(d for _, d in deletions)
    size = np.rint(rng.normal(MEAN, SD, n)).astype(int)
    left = rng.integers(0, length - removed - size.max() - 1, n)

    def to_reference(x):
        shift = np.zeros_like(x)
        for pos, d in sorted(deletions):
            shift = np.where(x + shift >= pos, shift + d, shift)
        return x + shift

    begin, end = to_reference(left), to_reference(left + size)
    whole = (to_reference(left + READ_LEN) - begin == READ_LEN) & (
        end - to_reference(left + size - READ_LEN) == READ_LEN
    )
    return pd.DataFrame({"start": begin + READ_LEN, "isize": end - begin})[whole]


def cohort(spark, deletions: list[tuple[int, int, dict[int, int]]], n_samples=6, length=60_000, depth=20, seed=7):
    """Profile of ``n_samples`` samples with ``(pos, len, {sample: copies})`` deletions."""
    rng = np.random.default_rng(seed)
    per_hap = int(length * depth / 2 / (MEAN - 2 * READ_LEN))
    pairs, hists, groups = [], [], []
    for s in range(n_samples):
        parts = []
        for copy in range(2):
            mine = [(p, d) for p, d, carriers in deletions if carriers.get(s, 0) > copy]
            parts.append(_haplotype(rng, length, per_hap, mine))
        rows = pd.concat(parts)
        usual = np.rint(rng.normal(MEAN, SD, 50_000)).astype(int)
        size, cnt = np.unique(usual, return_counts=True)
        median = int(np.median(usual))
        sd = float(usual.std(ddof=1))
        lo, hi = int(np.floor(median - 3 * sd)), int(np.ceil(median + 3 * sd)) + 1
        rg = f"rg{s}"
        win = rows["start"] // 256 * 256
        pairs.append(pd.DataFrame({
            "contig": "chr1", "win": win, "sample": f"s{s}", "rg": rg, "off": rows["start"] - win, "dev": rows["isize"] - median,
        }))
        hists.append(pd.DataFrame({"sample": f"s{s}", "rg": rg, "size": size, "cnt": cnt}))
        groups.append((rg, f"s{s}", median, float(usual.mean()), sd, READ_LEN, lo, hi, 30.0))
    from lacuna.sources import profiles as P

    return Profile(
        spark.createDataFrame(pd.concat(pairs), P.PAIRS),
        spark.createDataFrame(pd.concat(hists), P.HIST),
        spark.createDataFrame(groups, P.READ_GROUPS),
        spark.createDataFrame([("chr1", 0, length)], P.CONTIGS),
    )
