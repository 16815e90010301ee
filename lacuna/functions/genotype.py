"""Genotype formulas: priors, phred scores, genotype and filter strings, call quality."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

# Floor of priors and likelihoods, frequency borders of the cell-population prior.
PSEUDO = 1e-10
CELL_HET_FROM = 0.4
CELL_HOM_FROM = 0.75

#: Scaled likelihoods this close count as equal, so that the last bits of a sum decide nothing.
EQUAL_WITHIN = 1e-9

# Filter bits and their names in output order.
FILTER_LR = 1
FILTER_COVERAGE = 2
FILTER_SAMPLES = 4
FILTER_ALL_REF = 8
FILTER_WINDOW_COVER = 16
FILTER_NAMES = (
    (FILTER_LR, "lowLR"),
    (FILTER_COVERAGE, "highCov"),
    (FILTER_SAMPLES, "missingSamples"),
    (FILTER_ALL_REF, "allRefGT"),
    (FILTER_WINDOW_COVER, "CSWin"),
)

# Cap of phred scores in the output, prior behind the quality ladder.
PHRED_CAP = 255
LADDER_PRIOR = 1e-4
LADDER_STEPS = 100


def prior_hardy_weinberg(af: Column) -> tuple[Column, Column, Column]:
    """Genotype weights (reference, heterozygous, homozygous deletion) at an allele frequency."""
    low = F.lit(PSEUDO)
    return (
        F.greatest((1 - af) * (1 - af), low),
        F.greatest(2 * af * (1 - af), low),
        F.greatest(af * af, low),
    )


def prior_cell_population(af: Column) -> tuple[Column, Column, Column]:
    """Genotype weights for a population of cells instead of individuals."""
    low, one = F.lit(PSEUDO), F.lit(1.0)
    mixed, het = af <= CELL_HET_FROM, af < CELL_HOM_FROM
    return (
        F.when(mixed, F.greatest(1 - 2 * af + PSEUDO, low)).otherwise(low),
        F.when(mixed, F.greatest(2 * af - 2 * PSEUDO, low)).when(het, one).otherwise(low),
        F.when(mixed | het, low).otherwise(one),
    )


def prior(af: Column, cell_population: bool = False) -> tuple[Column, Column, Column]:
    return prior_cell_population(af) if cell_population else prior_hardy_weinberg(af)


def phred(g0: Column, g1: Column, g2: Column) -> tuple[Column, Column, Column]:
    """Phred-scaled distances of three log10 likelihoods from the best one, rounded."""
    best = F.greatest(g0, g1, g2)
    return tuple(F.round(10.0 * (best - g)).cast("bigint") for g in (g0, g1, g2))


def has_data(pl0: Column, pl1: Column, pl2: Column) -> Column:
    return (pl0 + pl1 + pl2) != 0


def genotype_quality(pl0: Column, pl1: Column, pl2: Column) -> Column:
    """Distance to the second best genotype, 0 where there is no data."""
    score = (
        F.when(~has_data(pl0, pl1, pl2), F.lit(0))
        .when(pl0 == 0, F.least(pl1, pl2))
        .when(pl1 == 0, F.least(pl0, pl2))
        .otherwise(F.least(pl0, pl1))
    )
    return F.least(score, F.lit(PHRED_CAP)).cast("bigint")


def genotype_string(pl0: Column, pl1: Column, pl2: Column) -> Column:
    first = F.when(pl2 == 0, F.lit("1")).otherwise(F.lit("0"))
    second = F.when(pl0 != 0, F.lit("1")).otherwise(F.lit("0"))
    return F.when(genotype_quality(pl0, pl1, pl2) == 0, F.lit("./.")).otherwise(
        F.concat(first, F.lit("/"), second)
    )


def phred_string(pl0: Column, pl1: Column, pl2: Column) -> Column:
    capped = F.concat_ws(",", *[F.least(p, F.lit(PHRED_CAP)).cast("string") for p in (pl0, pl1, pl2)])
    return F.when(genotype_quality(pl0, pl1, pl2) == 0, F.lit("0,0,0")).otherwise(capped)


def allele_count(pl0: Column, pl1: Column) -> Column:
    """Deleted alleles of one sample; a sample without data counts as reference."""
    return F.when(pl0 == 0, 0).when(pl1 == 0, 1).otherwise(2).cast("bigint")


def known_allele_counts(pl0: Column, pl1: Column, pl2: Column) -> tuple[Column, Column]:
    """(deleted alleles, alleles) of one sample when undetermined samples are left out."""
    unknown = (pl0 == 0) & (pl1 == 0)
    deleted = F.when(pl0 == 0, 0).when(pl1 == 0, 1).when(pl2 == 0, 2).otherwise(0)
    return deleted.cast("bigint"), F.when(unknown, 0).otherwise(2).cast("bigint")


def filter_string(bits: Column) -> Column:
    """Names of the set filter bits joined by ';', or PASS."""
    names = F.array(
        *[F.when(bits.bitwiseAND(F.lit(bit)) != 0, F.lit(name)) for bit, name in FILTER_NAMES]
    )
    return F.when(bits == 0, F.lit("PASS")).otherwise(F.concat_ws(";", F.array_compact(names)))


def likelihood_ladder(prior_probability: float = LADDER_PRIOR) -> list[float]:
    """Smallest likelihood ratio per integer quality 0..100.

    Quality ``q`` asks for a chi-squared (df = 1) tail of ``10^(-q/10)``; the quantile is the square
    of a normal quantile.
    """
    shift = math.log(prior_probability / (1 - prior_probability))
    normal = NormalDist()
    keys = [0.0]
    for q in range(1, LADDER_STEPS + 1):
        tail = 10.0 ** (-q / 10.0)
        keys.append(normal.inv_cdf(tail / 2.0) ** 2 / 2.0 - shift)
    return keys


def call_quality(lr: Column, prior_probability: float = LADDER_PRIOR) -> Column:
    """As-of lookup of a likelihood ratio on the ladder; the steps are sorted, so counting suffices."""
    ladder = F.array(*[F.lit(k) for k in likelihood_ladder(prior_probability)])
    return (F.size(F.filter(ladder, lambda k: k <= lr)) - 1).cast("bigint")


def quality_probability(quality: Column) -> Column:
    """Probability that a call of this quality is correct; 1 at the top of the ladder."""
    return F.when(quality >= LADDER_STEPS, F.lit(1.0)).otherwise(1.0 - F.pow(F.lit(10.0), -quality / 10.0))
