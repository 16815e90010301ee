"""One step of the length/frequency estimation as plain relational algebra.

Relations (all keyed by grid point ``contig, p`` and candidate ``len0``):

* ``obs(contig, p, sample, rg, dev, cnt)``: run-length deviations of usable read groups
* ``state(contig, p, len0, len, g0, g1, g2)``: current length and genotype weights
* ``density(rg, offset, values, min_prob, median, stddev, lower_q, upper_q)``

Every sum combines on the map side, so one grid point may hold any share of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions import genotype as G
from lacuna.functions.density import lookup
from lacuna.operators.em_kernel import SAME_WHOLE

KEY = ["contig", "p", "len0"]


def frequency_seed(obs: DataFrame, state: DataFrame, rg_stats: DataFrame) -> DataFrame:
    """Share of pairs whose deviation lies within two standard deviations of the candidate length."""
    length = F.col("len0")
    low = F.greatest(
        F.floor(length / 2).cast("bigint"),
        F.floor(length - 2 * F.col("stddev") + 0.5).cast("bigint"),
    )
    high = F.floor(length + 2 * F.col("stddev")).cast("bigint")
    inside = (F.col("dev") > low) & (F.col("dev") < high)
    return (
        obs.join(state.select(*KEY), ["contig", "p"])
        .join(rg_stats.select("rg", "stddev"), "rg")
        .groupBy(*KEY)
        .agg(
            F.sum(F.when(inside, F.col("cnt")).otherwise(0)).alias("inside"),
            F.sum("cnt").alias("total"),
        )
        .select(*KEY, (F.col("inside") / F.col("total")).alias("af"))
    )


def with_prior(state: DataFrame, cell_population: bool = False) -> DataFrame:
    g0, g1, g2 = G.prior(F.col("af"), cell_population)
    return state.withColumns({"g0": g0, "g1": g1, "g2": g2})


def pair_densities(
    obs: DataFrame, state: DataFrame, density: DataFrame, shifts: DataFrame | None = None
) -> DataFrame:
    """Adds to each observation its density under reference (``ref``) and deletion (``dl``)."""
    joined = obs.join(state, ["contig", "p"]).join(
        density.select("rg", "offset", "values", "min_prob", "median", "stddev"), "rg"
    )
    if shifts is None:
        joined = joined.withColumn("shift", F.lit(0).cast("bigint"))
    else:
        joined = joined.join(shifts.select(*KEY, "rg", "shift"), [*KEY, "rg"], "left").withColumn(
            "shift", F.coalesce("shift", F.lit(0).cast("bigint"))
        )
    place = (F.col("values"), F.col("min_prob"), F.col("offset"), F.col("median"))
    return (
        joined.withColumn("ref", lookup(*place, F.col("dev") - F.col("shift")))
        .withColumn("dl", lookup(*place, F.col("dev") - F.col("len")))
        .drop("values", "offset", "min_prob")
    )


def log_likelihoods(densities: DataFrame, *by: str) -> DataFrame:
    """Natural-log likelihoods of the three genotypes per candidate and ``by``."""
    cnt = F.col("cnt")
    return densities.groupBy(*KEY, *by).agg(
        F.sum(cnt * F.log("ref")).alias("l0"),
        F.sum(cnt * (F.log(F.col("ref") + F.col("dl")) - F.log(F.lit(2.0)))).alias("l1"),
        F.sum(cnt * F.log("dl")).alias("l2"),
    )


def scaled_likelihoods(logs: DataFrame) -> DataFrame:
    """``d0, d1, d2`` scaled by the best genotype.

    Underflow and three equal values both fall back to assuming the reference.
    """
    best = F.greatest("l0", "l1", "l2")
    raw = [F.exp(F.col(c) - best) for c in ("l0", "l1", "l2")]
    equal = F.least(*raw) > 1 - G.EQUAL_WITHIN
    fallback = (raw[0] == 0) | (raw[1] == 0) | (raw[2] == 0) | equal
    return logs.withColumns(
        {
            "d0": F.when(fallback, F.lit(1.0)).otherwise(raw[0]),
            "d1": F.when(fallback, F.lit(G.PSEUDO)).otherwise(raw[1]),
            "d2": F.when(fallback, F.lit(G.PSEUDO)).otherwise(raw[2]),
        }
    )


def group_likelihoods(logs: DataFrame) -> DataFrame:
    """Read-group likelihoods: scaled only, without the fallback of whole samples."""
    best = F.greatest("l0", "l1", "l2")
    return logs.select(
        *KEY, "rg",
        F.exp(F.col("l0") - best).alias("r0"),
        F.exp(F.col("l1") - best).alias("r1"),
        F.exp(F.col("l2") - best).alias("r2"),
    )


def weighted_genotypes() -> tuple[Column, Column, Column, Column]:
    """Products of likelihood and weight, and their sum."""
    p0, p1, p2 = (F.col(f"d{k}") * F.col(f"g{k}") for k in range(3))
    return p0, p1, p2, p0 + p1 + p2


def frequency_update(samples: DataFrame, weights: DataFrame, n_samples: int) -> DataFrame:
    """Mean posterior allele count over all samples, present or not.

    ``samples`` holds ``d0..d2`` of the samples with data. An absent sample has the fallback
    likelihoods, so its contribution depends on the weights only.
    """
    p0, p1, p2, total = weighted_genotypes()
    seen = (
        samples.select(*KEY, "sample", "d0", "d1", "d2").join(weights.select(*KEY, "g0", "g1", "g2"), KEY)
        .groupBy(*KEY, "g0", "g1", "g2")
        .agg(F.sum((p1 + 2 * p2) / total).alias("alleles"), F.count(F.lit(1)).alias("present"))
    )
    q0, q1, q2 = F.col("g0"), F.lit(G.PSEUDO) * F.col("g1"), F.lit(G.PSEUDO) * F.col("g2")
    absent = (F.lit(n_samples) - F.col("present")) * (q1 + 2 * q2) / (q0 + q1 + q2)
    return seen.select(*KEY, ((F.col("alleles") + absent) / 2.0 / F.lit(n_samples)).alias("af"))


def likelihood_ratio(samples: DataFrame, weights: DataFrame, n_samples: int) -> DataFrame:
    """Log ratio of the posterior-weighted likelihood against the reference."""
    p0, p1, p2, total = weighted_genotypes()
    mixed = (p0 * F.col("d0") + p1 * F.col("d1") + p2 * F.col("d2")) / total
    seen = (
        samples.select(*KEY, "sample", "d0", "d1", "d2").join(weights.select(*KEY, "g0", "g1", "g2"), KEY)
        .groupBy(*KEY, "g0", "g1", "g2")
        .agg(F.sum(F.log(mixed) - F.log("d0")).alias("lr"), F.count(F.lit(1)).alias("present"))
    )
    q0, q1, q2 = F.col("g0"), F.lit(G.PSEUDO) * F.col("g1"), F.lit(G.PSEUDO) * F.col("g2")
    blank = F.log((q0 + (q1 + q2) * F.lit(G.PSEUDO)) / (q0 + q1 + q2))
    return seen.select(*KEY, (F.col("lr") + (F.lit(n_samples) - F.col("present")) * blank).alias("lr"))


def length_moments(densities: DataFrame, samples: DataFrame, weights: DataFrame) -> DataFrame:
    """Weight and first moment of the deviations, weighted by the probability of a deletion."""
    p0, p1, p2, total = weighted_genotypes()
    posterior = samples.select(*KEY, "sample", "d0", "d1", "d2").join(
        weights.select(*KEY, "g0", "g1", "g2"), KEY
    ).select(*KEY, "sample", (p1 / total).alias("a1"), (p2 / total).alias("a2"))
    share = F.col("cnt") * (F.col("a1") * F.col("dl") / (F.col("dl") + F.col("ref")) + F.col("a2"))
    return (
        densities.select(*KEY, "sample", "dev", "cnt", "ref", "dl").join(posterior, [*KEY, "sample"])
        .groupBy(*KEY)
        .agg(F.sum(share).alias("weight"), F.sum(share * F.col("dev")).alias("moment"))
    )


def length_update(densities: DataFrame, samples: DataFrame, weights: DataFrame) -> DataFrame:
    """Next length: the weighted mean deviation, 0 when it is negative or undefined."""
    sums = length_moments(densities, samples, weights)
    mean = F.col("moment") / F.col("weight")
    return sums.select(
        *KEY,
        F.when((F.col("weight") == 0) | (mean < 0), F.lit(0)).otherwise(F.floor(mean + 0.5))
        .cast("bigint").alias("len"),
    )


def shift_update(densities: DataFrame, groups: DataFrame, weights: DataFrame) -> DataFrame:
    """Next reference shift per read group, 0 beyond one standard deviation."""
    r = [F.col(f"r{k}") * F.col(f"g{k}") for k in range(3)]
    total = r[0] + r[1] + r[2]
    posterior = groups.join(weights.select(*KEY, "g0", "g1", "g2"), KEY).select(
        *KEY, "rg", (r[0] / total).alias("b0"), (r[1] / total).alias("b1")
    )
    share = F.col("cnt") * (F.col("b1") * F.col("ref") / (F.col("dl") + F.col("ref")) + F.col("b0"))
    sums = (
        densities.select(*KEY, "rg", "stddev", "dev", "cnt", "ref", "dl").join(posterior, [*KEY, "rg"])
        .groupBy(*KEY, "rg", "stddev")
        .agg(F.sum(share).alias("weight"), F.sum(share * F.col("dev")).alias("moment"))
    )
    # The cast truncates towards zero; the last bits of a sum decide nothing.
    mean = F.col("moment") / F.col("weight")
    shift = (mean + F.signum(mean) * F.lit(SAME_WHOLE)).cast("bigint")
    return sums.select(
        *KEY, "rg",
        F.when(
            (F.col("weight") > 0) & (F.abs(shift) <= F.col("stddev")), shift
        ).otherwise(F.lit(0)).cast("bigint").alias("shift"),
    )


def depth_classes(densities: DataFrame) -> DataFrame:
    """Likelihood-based counts per candidate and sample: reference, ambiguous, deletion."""
    ref, dl, cnt = F.col("ref"), F.col("dl"), F.col("cnt")
    is_ref = ref >= 2 * dl
    is_del = ~is_ref & (dl >= 2 * ref)
    zero = F.lit(0)
    return densities.groupBy(*KEY, "sample").agg(
        F.sum(F.when(is_ref, cnt).otherwise(zero)).alias("lad_ref"),
        F.sum(F.when(~is_ref & ~is_del, cnt).otherwise(zero)).alias("lad_amb"),
        F.sum(F.when(is_del, cnt).otherwise(zero)).alias("lad_del"),
    )


def distribution_classes(
    obs: DataFrame, state: DataFrame, rg_stats: DataFrame, strict: bool = False
) -> DataFrame:
    """Range-based counts: reference only, both ranges, between, deletion only, beyond.

    ``strict`` tests a pair within the reference range against the upper instead of the lower
    border of the deletion range.
    """
    joined = obs.join(state.select(*KEY, "len"), ["contig", "p"]).join(
        rg_stats.select("rg", "lower_q", "upper_q"), "rg"
    )
    dev, cnt, zero = F.col("dev"), F.col("cnt"), F.lit(0)
    low, high = F.col("len") - F.col("lower_q"), F.col("len") + F.col("upper_q")
    in_ref = dev <= F.col("upper_q")
    both = in_ref & (dev >= (high if strict else low))
    classes = {
        "dad_ref": in_ref & ~both,
        "dad_both": both,
        "dad_between": ~in_ref & (dev < low),
        "dad_alt": ~in_ref & (dev >= low) & (dev <= high),
        "dad_right": ~in_ref & (dev >= low) & (dev > high),
    }
    return joined.groupBy(*KEY, "sample").agg(
        *[F.sum(F.when(test, cnt).otherwise(zero)).alias(name) for name, test in classes.items()]
    )
