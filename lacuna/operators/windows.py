"""Windows along a contig: bins, pair spans, the calling grid and what is active on it.

A pair is *active* at grid point P when it starts at or before P and its last window, extended by
one step, reaches P. Grid points are multiples of the step, so activity is an equi-grouping on the
exploded grid instead of a range join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.arrays import round_half_up, upper_quartile_rank
from lacuna.params import GRID_STEP, PROFILE_WINDOW

#: Width of a tile of the grid, within which places are joined by equality.
GRID_TILE = 16 * GRID_STEP
#: Values of one axis closer than this belong to one candidate length.
CHAIN_GAP = 50


def bin_start(pos: Column, width: int) -> Column:
    """Start of the fixed-width bin that holds a non-negative position."""
    return (F.floor(pos / F.lit(width)) * F.lit(width)).cast("bigint")


def profile_bin(pos: Column) -> Column:
    return bin_start(pos, PROFILE_WINDOW)


def grid_bin(pos: Column) -> Column:
    return bin_start(pos, GRID_STEP)


def with_span(pairs: DataFrame, rg_stats: DataFrame) -> DataFrame:
    """Adds ``dev``, ``end_pos`` and ``last_win`` to ``pairs(contig, sample, rg, start, isize)``.

    ``rg_stats`` has one row per read group; whether it is broadcast is left to its measured size.
    """
    stats = rg_stats.select("rg", "median", "read_len")
    inner = F.greatest(F.lit(0).cast("bigint"), F.col("isize") - 2 * F.col("read_len"))
    return (
        pairs.join(stats, "rg")
        .withColumn("dev", F.col("isize") - F.col("median"))
        .withColumn("end_pos", F.col("start") + inner)
        .withColumn("last_win", grid_bin(F.col("end_pos")))
        .drop("median", "read_len")
    )


def active_grid(start: Column, last_win: Column) -> Column:
    """Array of the grid points at which a pair is active."""
    first = F.ceil(start / F.lit(GRID_STEP)) * GRID_STEP
    return F.sequence(first.cast("bigint"), (last_win + GRID_STEP).cast("bigint"), F.lit(GRID_STEP).cast("bigint"))


def active_pairs(spanned: DataFrame) -> DataFrame:
    """One row per pair and grid point ``p`` at which it is active."""
    return spanned.select(
        "contig", "sample", "rg", "start", "dev", "end_pos",
        F.explode(active_grid(F.col("start"), F.col("last_win"))).alias("p"),
    )


def grid_tiles(spanned: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of every pair once per tile that holds one of its grid points, with ``tile``, ``g_beg`` and ``g_end``.

    ``g_beg`` to ``g_end`` are the pair's grid points inside the tile.
    """
    first = (F.ceil(F.col("start") / F.lit(GRID_STEP)) * GRID_STEP).cast("bigint")
    last = (F.col("last_win") + GRID_STEP).cast("bigint")
    tile = lambda p: F.floor(p / F.lit(GRID_TILE))
    spread = spanned.select(
        "contig", *columns, first.alias("_first"), last.alias("_last"),
        F.explode(F.sequence(tile(first), tile(last))).alias("tile"),
    )
    return spread.select(
        "contig", *columns, "tile",
        F.greatest(F.col("_first"), F.col("tile") * GRID_TILE).alias("g_beg"),
        F.least(F.col("_last"), F.col("tile") * GRID_TILE + (GRID_TILE - GRID_STEP)).alias("g_end"),
    )


def outlier_spans(spanned: DataFrame, rg_thresholds: DataFrame) -> DataFrame:
    """Tiles and grid points of the pairs above the smallest threshold.

    A candidate length is a mean of per-sample upper quartiles above that threshold, and a
    quartile cannot exceed the largest value, so every other place is candidate-free. The
    threshold is one scalar, fetched by an uncorrelated subquery.
    """
    lowest = rg_thresholds.select(F.min("min_init_len")).scalar()
    return grid_tiles(spanned.where(F.col("dev") > lowest))


def outlier_windows(spanned: DataFrame, rg_thresholds: DataFrame) -> DataFrame:
    """Grid points that can possibly hold a candidate."""
    points = F.explode(F.sequence("g_beg", "g_end", F.lit(GRID_STEP).cast("bigint")))
    return outlier_spans(spanned, rg_thresholds).select("contig", points.alias("p")).distinct()


def pruned_active(spanned: DataFrame, rg_thresholds: DataFrame) -> DataFrame:
    """Active pairs in the tiles that can possibly hold a candidate.

    Pairs are joined to these tiles before anything is exploded to the grid.
    """
    hot = outlier_spans(spanned, rg_thresholds).select("contig", "tile").distinct()
    near = grid_tiles(spanned, "sample", "rg", "start", "dev", "end_pos").join(hot, ["contig", "tile"], "left_semi")
    return near.select(
        "contig", "sample", "rg", "start", "dev", "end_pos",
        F.explode(F.sequence("g_beg", "g_end", F.lit(GRID_STEP).cast("bigint"))).alias("p"),
    )


def active_coverage(active: DataFrame) -> DataFrame:
    """Active pairs per grid point and sample."""
    return active.groupBy("contig", "p", "sample").agg(F.count(F.lit(1)).alias("n_active"))


def deviation_counts(active: DataFrame) -> DataFrame:
    """Run-length form of the active deviations.

    The grouping combines on the map side, so however many pairs pile up at one place, at most one
    row per distinct deviation leaves each task.
    """
    return active.groupBy("contig", "p", "sample", "rg", "dev").agg(
        F.count(F.lit(1)).alias("cnt"),
        F.min("start").alias("first"),
        F.max("end_pos").alias("last"),
    )


def with_load(counts: DataFrame, max_load: DataFrame | None, default_load: int) -> DataFrame:
    """Adds the load ``n`` of the read group at the grid point and whether it is saturated."""
    if max_load is None:
        limited = counts.withColumn("max_load", F.lit(default_load).cast("bigint"))
    else:
        limited = counts.join(max_load.select("rg", "max_load"), "rg", "left").withColumn(
            "max_load", F.coalesce("max_load", F.lit(default_load).cast("bigint"))
        )
    group = Window.partitionBy("contig", "p", "sample", "rg")
    # One hash exchange serves this window and everything per sample that follows.
    return (
        limited.repartition("contig", "p", "sample")
        .withColumn("n", F.sum("cnt").over(group))
        .withColumn("high_cov", F.col("n") >= F.col("max_load"))
        .drop("max_load")
    )


def usable(loaded: DataFrame) -> DataFrame:
    """Observations ``(contig, p, sample, rg, dev, cnt)`` of the read groups below their limit."""
    return loaded.where(~F.col("high_cov")).select("contig", "p", "sample", "rg", "dev", "cnt")


def sample_windows(loaded: DataFrame, rg_thresholds: DataFrame) -> DataFrame:
    """One row per grid point and sample: load, outermost positions, third quartile, threshold.

    Saturated groups count towards ``n_active`` (data is present) but contribute no deviations.
    ``q3`` is NULL with fewer than two active pairs or without usable ones.
    """
    whole = Window.partitionBy("contig", "p", "sample")
    # Saturated groups sort last, so running counts over the usable rows are unaffected by them.
    running = whole.orderBy("high_cov", "dev", "rg").rowsBetween(Window.unboundedPreceding, 0)
    ok = ~F.col("high_cov")
    ranked = (
        loaded.join(rg_thresholds.select("rg", "min_init_len"), "rg")
        .withColumn("m", F.sum(F.when(ok, F.col("cnt")).otherwise(0)).over(whole))
        .withColumn("upto", F.sum("cnt").over(running))
        .withColumn("low", F.floor(upper_quartile_rank(F.col("m"))).cast("bigint"))
    )
    holds = lambda k: ok & (F.col("upto") > k) & (F.col("upto") - F.col("cnt") <= k)
    merged = ranked.groupBy("contig", "p", "sample").agg(
        F.sum("cnt").alias("n_active"),
        F.max("m").alias("m"),
        F.min(F.when(ok, F.col("first"))).alias("first"),
        F.max(F.when(ok, F.col("last"))).alias("last"),
        F.min("min_init_len").alias("threshold"),
        F.max(F.when(ok, F.col("dev"))).alias("top"),
        F.max(F.when(holds(F.col("low")), F.col("dev"))).alias("v0"),
        F.max(F.when(holds(F.col("low") + 1), F.col("dev"))).alias("v1"),
    )
    pos = upper_quartile_rank(F.col("m"))
    frac = pos - F.floor(pos)
    mixed = round_half_up((1 - frac) * F.col("v0") + frac * F.col("v1"))
    q3 = F.when(
        (F.col("n_active") >= 2) & (F.col("m") > 0), F.when(F.col("m") < 4, F.col("top")).otherwise(mixed)
    )
    return merged.withColumn("q3", q3).drop("m", "top", "v0", "v1")


def candidate_lengths(quartiles: DataFrame) -> DataFrame:
    """Chains per-sample quartiles along the value axis and averages each chain.

    ``quartiles(contig, p, q3, threshold)`` is reduced to distinct values first, so a grid point
    never holds more rows than there are distinct deviations, whatever the cohort size.
    """
    values = quartiles.where(F.col("q3").isNotNull()).groupBy("contig", "p", "q3").agg(
        F.count(F.lit(1)).alias("m"), F.min("threshold").alias("threshold")
    )
    axis = Window.partitionBy("contig", "p").orderBy("q3")
    opens = F.coalesce(F.col("q3") - F.lag("q3").over(axis) >= CHAIN_GAP, F.lit(True))
    chained = values.withColumn("opens", opens.cast("int")).withColumn("chain", F.sum("opens").over(axis))
    means = chained.groupBy("contig", "p", "chain").agg(
        F.sum(F.col("q3") * F.col("m")).alias("total"),
        F.sum("m").alias("n"),
        F.min("threshold").alias("threshold"),
    )
    length = F.expr("total div n")
    return (
        means.withColumn("len0", length)
        .where(F.col("len0") > F.col("threshold"))
        .select("contig", "p", "len0")
    )


def first_last(active: DataFrame) -> DataFrame:
    """Outermost positions of the active pairs per grid point and sample."""
    return active.groupBy("contig", "p", "sample").agg(
        F.min("start").alias("first_pos"), F.max("end_pos").alias("last_pos")
    )


def rank_pick(values: DataFrame, keys: list[str], value: str, p: float, out: str) -> DataFrame:
    """Value at 0-based rank ``floor((total - 1) p + 0.5)`` per key; ``values`` has a count ``n`` per row.

    Counts per distinct value first; the ordered window then runs over distinct positions only,
    whose number is bounded by the longest pair span.
    """
    counts = values.groupBy(*keys, value).agg(F.sum("n").alias("cnt"))
    whole = Window.partitionBy(*keys)
    ordered = whole.orderBy(value)
    rank = F.floor((F.sum("cnt").over(whole) - 1) * F.lit(p) + F.lit(0.5))
    upto = F.sum("cnt").over(ordered)
    return (
        counts.withColumn("rank", rank)
        .withColumn("upto", upto)
        .where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("cnt") <= F.col("rank")))
        .select(*keys, F.col(value).alias(out))
    )


def support_positions(support: DataFrame, keys: list[str]) -> DataFrame:
    """80th percentile of supporting starts, 20th of supporting ends, of rows counted ``n`` times."""
    starts = rank_pick(support, keys, "start", 0.8, "pos")
    ends = rank_pick(support, keys, "end_pos", 1 - 0.8, "end_pos")
    return starts.join(ends, keys)
