"""Merging of neighbouring window calls into final calls.

Clustering depends on order and on the running state of the cluster head, so it runs per segment in
pandas. It sees only slim rows, and a segment of fixed length holds a bounded number of grid points
and candidates; everything per sample is aggregated by Spark afterwards.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions import genotype as G
from lacuna.functions.arrays import padded_upper_median, round_half_up
from lacuna.operators.em import KEY
from lacuna.operators.genotyping import COUNTS
from lacuna.params import GRID_STEP

# Fixed values of the similarity rules.
SIZE_RATIO = 0.5
SIZE_SIGMAS = 2
OVERLAP_SHARE = 0.25
RANGE_SIGMAS = 4

#: Calls compared with a head at a time.
LOOK_AHEAD = 64


def _against(head: tuple[int, int, int], pos, end, length, sigma: float) -> tuple[np.ndarray, np.ndarray]:
    """How calls relate to a cluster head (pos, end, length): they overlap it, or they only continue it.

    Calls of dissimilar length do neither. A call continues the head where one of the two spans falls short of
    its deletion and the call begins within the shorter deletion.
    """
    h_pos, h_end, h_len = head
    h_span, span = max(0, h_end - h_pos), np.maximum(0, end - pos)
    small, large = np.minimum(h_len, length), np.maximum(h_len, length)
    alike = (large - small <= SIZE_SIGMAS * sigma) | (small >= SIZE_RATIO * large)
    shorter = np.minimum(h_span, span)
    shared = np.minimum(h_pos + h_span, pos + span) - np.maximum(h_pos, pos)
    overlaps = alike & ((shared >= OVERLAP_SHARE * shorter) | (shorter - shared <= SIZE_SIGMAS * sigma))
    open_end = (h_span < h_len) | (span < length)
    continues = alike & ~overlaps & open_end & (pos - h_pos < small + RANGE_SIGMAS * sigma)
    return overlaps, continues


def cluster_ids(pos, end, length, passing, sigma: float, keep_failed: bool) -> np.ndarray:
    """Cluster number per call of a sorted segment, -1 for calls outside any cluster.

    A head takes the calls after it while they overlap it. One that only continues it moves its end, any other
    becomes the next head.
    """
    n = len(pos)
    ids = np.full(n, -1, dtype=np.int64)
    starts = np.arange(n) if keep_failed else np.flatnonzero(passing)
    if n < 2 or not len(starts):
        return ids
    at, current = int(starts[0]), -1
    head: tuple[int, int, int] | None = None
    while at < n:
        taken, moves = 0, False
        if head is not None:
            ahead = slice(at, at + LOOK_AHEAD)
            overlaps, continues = _against(head, pos[ahead], end[ahead], length[ahead], sigma)
            taken = int(np.argmin(overlaps)) if not overlaps.all() else len(overlaps)
            moves = taken < len(overlaps) and bool(continues[taken])
        if taken:
            ids[at : at + taken] = current
            at += taken
            if at == n or taken == LOOK_AHEAD:
                continue
        if moves:
            head = head[0], int(end[at]), head[2]
        else:
            current += 1
            head = int(pos[at]), int(end[at]), int(length[at])
        ids[at] = current
        at += 1
    alone = np.bincount(ids[ids >= 0])[np.maximum(ids, 0)] < 2
    ids[alone] = -1
    return ids


ORDER = ["pos", "len", "neg_lr", "win_pos", "len0"]


def cluster_calls(calls: DataFrame, sigma: float, keep_failed: bool = False) -> DataFrame:
    """Adds ``cluster`` and ``head`` to segmented window calls; calls without partners drop out."""
    slim = calls.select(
        "contig", "segment", "p", "len0", "win_pos", "pos", "end_pos", "len", "lr", "iterations", "filter"
    )
    out = (
        "contig string, segment bigint, p bigint, len0 bigint, win_pos bigint, pos bigint, end_pos bigint,"
        " len bigint, lr double, iterations bigint, filter bigint, cluster bigint, head boolean"
    )

    def unify(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(neg_lr=-pdf["lr"]).sort_values(ORDER, kind="stable").drop(columns="neg_lr")
        ids = cluster_ids(
            pdf["pos"].to_numpy(), pdf["end_pos"].to_numpy(), pdf["len"].to_numpy(),
            (pdf["filter"] == 0).to_numpy(), sigma, keep_failed,
        )
        pdf = pdf.assign(cluster=ids)
        pdf = pdf[pdf["cluster"] >= 0]
        return pdf.assign(head=~pdf["cluster"].duplicated())

    return slim.groupBy("contig", "segment").applyInPandas(unify, out)


CALL = ["contig", "segment", "cluster"]


def merged_positions(clustered: DataFrame, min_window_cover: float) -> DataFrame:
    """Position, length and ratio of every cluster: medians over its contributing members.

    A cluster lies within one segment, so its members are bounded in number.
    """
    counts = F.col("head") | (F.col("filter") == 0)
    middle = lambda c: F.get(
        F.array_sort(F.collect_list(F.when(counts, F.col(c)))),
        F.floor(F.count(F.when(counts, F.lit(1))) / 2).cast("int"),
    )
    heads = clustered.groupBy(*CALL).agg(
        middle("pos").alias("pos"),
        middle("len").alias("len"),
        F.avg("lr").alias("lr"),
        F.count(F.when(counts, F.lit(1))).alias("sig_windows"),
        F.max(F.when(F.col("head"), F.col("filter"))).alias("filter"),
        F.max(F.when(F.col("head"), F.col("p"))).alias("head_p"),
        F.max(F.when(F.col("head"), F.col("len0"))).alias("init_len"),
        F.max(F.when(F.col("head"), F.col("win_pos"))).alias("win_pos"),
        F.max(F.when(F.col("head"), F.col("end_pos"))).alias("end_pos"),
        F.max(F.when(F.col("head"), F.col("iterations"))).alias("iterations"),
    )
    thin = F.lit(float(GRID_STEP)) * F.col("sig_windows") / F.col("len") < min_window_cover
    return heads.withColumn(
        "filter",
        F.when(thin, F.col("filter").bitwiseOR(F.lit(G.FILTER_WINDOW_COVER))).otherwise(F.col("filter")),
    )


def genotype_members(clustered: DataFrame, merged: DataFrame) -> DataFrame:
    """Members whose grid point lies within the merged deletion, with their number per call."""
    inside = (F.col("win_pos") > F.col("call_pos")) & (
        F.col("win_pos") - GRID_STEP < F.col("call_pos") + F.col("call_len")
    )
    spans = merged.select(*CALL, F.col("pos").alias("call_pos"), F.col("len").alias("call_len"))
    return (
        clustered.select(*CALL, "p", "len0", "win_pos").join(spans, CALL).where(inside).select(*CALL, "p", "len0")
    )


def averaged_phred(sums: list, n) -> list:
    """Mean distance from the best genotype per genotype, ties broken by the unrounded values."""
    low = F.least(*sums)
    ref, het, hom = ((s - low) / n for s in sums)
    r0, r1, r2 = (round_half_up(x) for x in (ref, het, hom))
    tie_alt = r1 == r2
    tie_ref = ~tie_alt & (r0 == r1)
    bump = lambda test: F.when(test, F.lit(1)).otherwise(F.lit(0))
    return [
        r0 + bump(tie_ref & (ref > het)),
        r1 + bump((tie_alt & (het > hom)) | (tie_ref & ~(ref > het))),
        r2 + bump(tie_alt & ~(het > hom)),
    ]


def call_genotypes(members: DataFrame, genotyped: DataFrame) -> DataFrame:
    """Final genotype and median depths per call and sample with data in some member window."""
    windows = members.groupBy(*CALL).agg(F.count(F.lit(1)).alias("n_windows"))
    rows = genotyped.select(*KEY, "sample", "pl0", "pl1", "pl2", *COUNTS).join(members, KEY)
    sums = rows.groupBy(*CALL, "sample").agg(
        *[F.sum(f"pl{k}").alias(f"s{k}") for k in range(3)],
        *[F.array_sort(F.collect_list(c)).alias(c) for c in COUNTS],
    ).join(windows, CALL)
    pl = averaged_phred([F.col(f"s{k}") for k in range(3)], F.col("n_windows"))
    return sums.select(
        *CALL, "sample", "n_windows",
        *[pl[k].cast("bigint").alias(f"pl{k}") for k in range(3)],
        *[padded_upper_median(F.col(c), F.col("n_windows")).alias(c) for c in COUNTS],
    )


def head_positions(merged: DataFrame, genotyped: DataFrame) -> DataFrame:
    """First and last active position per sample at the head's grid point."""
    heads = merged.select(*CALL, F.col("head_p").alias("p"), F.col("init_len").alias("len0"))
    return genotyped.select(*KEY, "sample", "first", "last").join(heads, KEY).select(
        *CALL, "sample", "first", "last"
    )


def finish_calls(merged: DataFrame, samples: DataFrame, n_samples: int) -> DataFrame:
    """Calls with at least one genotyping window, their frequency taken from the genotypes."""
    alleles = samples.groupBy(*CALL).agg(
        F.sum(G.allele_count(F.col("pl0"), F.col("pl1"))).alias("alleles")
    )
    return merged.join(alleles, CALL).withColumn("af", F.col("alleles") / F.lit(2.0 * n_samples)).drop("alleles")


def merge_calls(
    calls: DataFrame, genotyped: DataFrame, sigma: float, n_samples: int,
    min_window_cover: float, keep_failed: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Segmented window calls to ``(calls, samples)``."""
    from lacuna.session import materialise

    clustered = materialise(cluster_calls(calls, sigma, keep_failed))
    merged = merged_positions(clustered, min_window_cover)
    members = genotype_members(clustered, merged)
    genotypes = call_genotypes(members, genotyped)
    firsts = head_positions(merged, genotyped)
    zero = F.lit(0).cast("bigint")
    samples = genotypes.join(firsts, [*CALL, "sample"], "full").withColumns(
        {c: F.coalesce(c, zero) for c in ("first", "last", "pl0", "pl1", *COUNTS)}
    ).withColumn("pl2", F.coalesce("pl2", F.lit(1).cast("bigint")))
    finished = finish_calls(merged, genotypes, n_samples)
    if not keep_failed:
        finished = finished.where(F.col("filter") == 0)
    return finished.where(F.col("iterations") != 0), samples
