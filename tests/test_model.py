"""The estimation against a plain loop, and its three ways against each other."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from lacuna.operators import genotyping
from lacuna.operators.em_kernel import Settings

EPS = 1e-10
N_SAMPLES = 4
OFFSET, SLOTS, MEDIAN, SD = 200, 301, 350, 40.0


def curve(seed: int) -> np.ndarray:
    x = np.arange(SLOTS) + OFFSET
    v = np.exp(-((x - MEDIAN - seed) ** 2) / (2 * SD * SD))
    v /= v.sum()
    return np.maximum(v, v.max() / 500)


DENSITY = {f"g{i}": curve(i) for i in range(6)}


def random_points(seed: int):
    """(contig, p) -> list of (sample, rg, dev, cnt) with carriers of a 300 bp deletion."""
    rng = random.Random(seed)
    points = {}
    for k in range(12):
        rows = {}
        for s in range(N_SAMPLES):
            for g in (s, 4 + s % 2) if s < 2 else (s,):
                for _ in range(rng.randint(0, 7)):
                    carrier = s % 2 == 0 and rng.random() < 0.6
                    dev = round(rng.gauss(300 if carrier else 0, SD))
                    rows[f"s{s}", f"g{g}", dev] = rows.get((f"s{s}", f"g{g}", dev), 0) + rng.choice([1, 1, 2])
        if rows:
            points["c", 30 * k] = [(*key, n) for key, n in sorted(rows.items())]
    return points


def density(rg: str, dev: int) -> float:
    v = DENSITY[rg]
    i = dev + MEDIAN - OFFSET
    return float(v.min()) if i <= 0 or i + 1 >= len(v) else float(v[i])


def prior(af):
    return [max((1 - af) ** 2, EPS), max(2 * af * (1 - af), EPS), max(af * af, EPS)]


def likelihoods(rows, length, shift):
    """Per sample and per read group: log likelihoods."""
    sample, group = {}, {}
    for s, g, dev, n in rows:
        ref, dl = density(g, dev - shift.get(g, 0)), density(g, dev - length)
        terms = (math.log(ref), math.log(ref + dl) - math.log(2), math.log(dl))
        for acc, key in ((sample, s), (group, g)):
            old = acc.setdefault(key, [0.0, 0.0, 0.0])
            for i in range(3):
                old[i] += n * terms[i]
    return sample, group


def scaled(logs):
    return [math.exp(x - max(logs)) for x in logs]


def with_fallback(d):
    return [1.0, EPS, EPS] if min(d) == 0 or min(d) > 1 - 1e-9 else d


def all_samples(sample):
    return [with_fallback(scaled(sample.get(f"s{i}", [0, 0, 0]))) for i in range(N_SAMPLES)]


def ratio(ds, g):
    total = 0.0
    for d in ds:
        p = [d[i] * g[i] for i in range(3)]
        a = [x / sum(p) for x in p]
        total += math.log(sum(a[i] * d[i] for i in range(3))) - math.log(d[0])
    return total


def estimate(rows, len0, s: Settings):
    """One candidate, written as the rule reads."""
    inside = total = 0
    for _, _, dev, n in rows:
        total += n
        if max(len0 // 2, math.floor(len0 - 2 * SD + 0.5)) < dev < math.floor(len0 + 2 * SD):
            inside += n
    af = inside / total if total else 0.0
    if af == 0:
        return None
    shift, g, length, it, visited = {}, prior(af), len0, 0, {}
    while length >= s.min_len and it < s.iterations:
        it += 1
        visited[length] = af
        old = (length, af, dict(shift), g)
        sample, group = likelihoods(rows, length, shift)
        weight = moment = 0.0
        sums = {}
        for smp, rg, dev, n in rows:
            d = with_fallback(scaled(sample[smp]))
            a = sum(d[i] * g[i] for i in range(3))
            r = scaled(group[rg])
            b = sum(r[i] * g[i] for i in range(3))
            ref, dl = density(rg, dev - shift.get(rg, 0)), density(rg, dev - length)
            w = n * (d[1] * g[1] / a * dl / (dl + ref) + d[2] * g[2] / a)
            u = n * (r[1] * g[1] / b * ref / (dl + ref) + r[0] * g[0] / b)
            weight, moment = weight + w, moment + w * dev
            x = sums.setdefault(rg, [0.0, 0.0])
            x[0] += u
            x[1] += u * dev
        length = 0 if weight == 0 or moment < 0 else math.floor(moment / weight + 0.5)
        shift = {rg: (0 if w <= 0 or abs(int(m / w)) > SD else int(m / w)) for rg, (w, m) in sums.items()}
        ds = all_samples(likelihoods(rows, length, shift)[0])
        alleles = 0.0
        for d in ds:
            p = [d[i] * g[i] for i in range(3)]
            alleles += (p[1] + 2 * p[2]) / sum(p)
        af = alleles / 2 / N_SAMPLES
        if af == 0:
            break
        g = prior(af)
        if length in visited and abs(visited[length] - af) <= 1e-4:
            before = ratio(all_samples(likelihoods(rows, old[0], old[2])[0]), old[3])
            if before > ratio(ds, g):
                length, af, shift = old[:3]
            break
    if af < EPS or length < s.min_len:
        return None
    sample, _ = likelihoods(rows, length, shift)
    lr = ratio(all_samples(sample), g)
    if lr < s.min_lr:
        return None
    pl = {}
    for name, logs in sample.items():
        ten = [x / math.log(10) for x in logs]
        gap = [max(ten) - x for x in ten]
        if max(gap) < 1e-9:
            gap = [0, 10, 10]
        n = sum(c for smp, _, _, c in rows if smp == name)
        pl[name] = [math.floor(10 * x + 0.5) if n >= 2 else 0 for x in gap]
    return {"len": length, "af": af, "lr": lr, "iterations": it, "pl": pl}


SETTINGS = Settings(N_SAMPLES, 50, 0.5, 15, False, False)


@pytest.fixture(scope="module")
def case(spark):
    points = random_points(3)
    rows, expected = [], {}
    for (contig, p), obs in points.items():
        for len0 in (150, 280):
            expected[contig, p, len0] = estimate(obs, len0, SETTINGS)
            rows += [(contig, p, s, g, d, n, p - 10, p + 20, False, len0) for s, g, d, n in obs]
    observed = spark.createDataFrame(
        rows,
        "contig string, p bigint, sample string, rg string, dev bigint, cnt bigint, first bigint, last bigint,"
        " high_cov boolean, len0 bigint",
    )
    density_table = spark.createDataFrame(
        [(g, OFFSET, v.tolist(), float(v.min()), MEDIAN, SD, 90, 90) for g, v in DENSITY.items()],
        "rg string, offset bigint, values array<double>, min_prob double, median bigint, stddev double,"
        " lower_q bigint, upper_q bigint",
    )
    return observed, density_table, {k: v for k, v in expected.items() if v}


def collected(df):
    out = {}
    for r in df.collect():
        key = r["contig"], r["p"], r["len0"]
        one = out.setdefault(key, {"pl": {}, "leads": 0})
        one["leads"] += r["lead"]
        one.update(len=r["len"], af=r["af"], lr=r["lr"], iterations=r["iterations"])
        one["pl"][r["sample"]] = [r["pl0"], r["pl1"], r["pl2"]]
    return out


def check(got, expected):
    assert expected and got.keys() == expected.keys()
    for key, want in expected.items():
        have = got[key]
        assert have["leads"] == 1
        assert (have["len"], have["iterations"]) == (want["len"], want["iterations"]), key
        assert have["af"] == pytest.approx(want["af"], rel=1e-6)
        assert have["lr"] == pytest.approx(want["lr"], rel=1e-6)
        assert have["pl"] == want["pl"], key


def test_batches_match_the_plain_loop(case):
    observed, dens, expected = case
    check(collected(genotyping.genotype_windows(observed, dens, SETTINGS)), expected)


@pytest.mark.parametrize("block_samples", [1, 3])
def test_blocks_of_samples_match_the_plain_loop(case, block_samples):
    observed, dens, expected = case
    check(collected(genotyping.genotype_windows(observed, dens, SETTINGS, block_samples)), expected)
