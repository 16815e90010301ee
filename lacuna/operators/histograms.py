"""Insert-size histograms per read group: counts, moments, trimming, densities.

Canonical relations: ``hist(rg, size, cnt)`` in long form, ``rg_stats`` with one row per read
group, ``density(rg, offset, values, min_prob)`` in dense form. A histogram has at most
``max_size`` rows per read group, so ordered work per read group stays small at any depth.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.functions.density import dense, quantile_slots, shape, smooth
from lacuna.functions.arrays import round_half_up, weighted_kth

TRIM_SIGMAS = 3.0


def capped_size(tlen: Column, max_size: int) -> Column:
    """Insert size with everything beyond the histogram collected in the last slot."""
    return F.least(F.abs(tlen).cast("bigint"), F.lit(max_size - 1).cast("bigint"))


def insert_size_histogram(sizes: DataFrame, *extra: str) -> DataFrame:
    """``(rg, size)`` rows to ``hist``."""
    return sizes.groupBy("rg", *extra, "size").agg(F.count(F.lit(1)).alias("cnt"))


def moments(hist: DataFrame) -> DataFrame:
    """Count-weighted mean and corrected standard deviation per read group.

    Two passes over the small histogram keep the variance free of cancellation.
    """
    mean = hist.groupBy("rg").agg(
        F.sum("cnt").alias("n"), (F.sum(F.col("size") * F.col("cnt")) / F.sum("cnt")).alias("mean")
    )
    spread = (
        hist.join(mean, "rg")
        .groupBy("rg")
        .agg(
            F.max("n").alias("n"),
            F.max("mean").alias("mean"),
            F.sum(F.col("cnt") * F.pow(F.col("size") - F.col("mean"), F.lit(2))).alias("ss"),
        )
    )
    return spread.select(
        "rg", "n", "mean", F.when(F.col("n") > 1, F.sqrt(F.col("ss") / (F.col("n") - 1))).alias("stddev")
    )


def lower_median(hist: DataFrame) -> DataFrame:
    """Smallest size at which the running count reaches half of the total."""
    whole = Window.partitionBy("rg")
    upto = F.sum("cnt").over(whole.orderBy("size"))
    total = F.sum("cnt").over(whole)
    return (
        hist.withColumn("upto", upto)
        .withColumn("total", total)
        .where(F.col("upto") * 2 >= F.col("total"))
        .groupBy("rg")
        .agg(F.min("size").alias("median"))
    )


def trim_borders(median: Column, stddev: Column, slots: Column) -> tuple[Column, Column]:
    """Half-open size range within three standard deviations of the median."""
    lo = F.greatest(F.lit(1).cast("bigint"), F.floor(median - TRIM_SIGMAS * stddev).cast("bigint"))
    hi = F.least(
        slots.cast("bigint") - 1, F.ceil(median + TRIM_SIGMAS * stddev).cast("bigint") + 1
    )
    return lo, hi


def _trim_one(size: np.ndarray, cnt: np.ndarray, slots: int) -> tuple[int, int, int, float, float]:
    """Repeats statistics and trimming until the borders stay put.

    Borders that come round in a cycle settle on its smallest member, so the result does not depend on where
    the cycle is entered.
    """
    lo, hi = 1, slots - 1
    median, mean, stddev = 0, float("nan"), float("nan")
    seen: list[tuple[int, int]] = []
    settled = False
    while True:
        keep = (size >= lo) & (size < hi)
        s, c = size[keep], cnt[keep].astype(float)
        n = c.sum()
        if n == 0:
            raise ValueError("no pairs left in the histogram; use more or other sampling intervals")
        mean = float((s * c).sum() / n)
        stddev = float(np.sqrt((c * (s - mean) ** 2).sum() / (n - 1))) if n > 1 else 0.0
        median = int(s[np.searchsorted(np.cumsum(c), n / 2.0)])
        new_lo = max(1, int(np.floor(median - TRIM_SIGMAS * stddev)))
        new_hi = min(slots - 1, int(np.ceil(median + TRIM_SIGMAS * stddev)) + 1)
        if settled or (new_lo, new_hi) == (lo, hi):
            break
        seen.append((lo, hi))
        if (new_lo, new_hi) in seen:
            new_lo, new_hi = min(seen[seen.index((new_lo, new_hi)) :])
            settled = True
        lo, hi = new_lo, new_hi
    return lo, hi, median, mean, stddev


def trimmed_stats(hist: DataFrame, max_size: int) -> DataFrame:
    """Fixed point of the 3-sigma trimming per read group.

    The loop is data dependent, so it runs in pandas on the read group's histogram, which holds at
    most ``max_size`` rows.
    """

    def trim(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size")
        lo, hi, median, mean, stddev = _trim_one(pdf["size"].to_numpy(), pdf["cnt"].to_numpy(), max_size)
        return pd.DataFrame(
            {"rg": pdf["rg"].iloc[:1].to_numpy(), "lo": [lo], "hi": [hi], "median": [median],
             "mean": [mean], "stddev": [stddev]}
        )

    rg_type = hist.schema["rg"].dataType.simpleString()
    return hist.select("rg", "size", "cnt").groupBy("rg").applyInPandas(
        trim, f"rg {rg_type}, lo bigint, hi bigint, median bigint, mean double, stddev double"
    )


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _dense(slots: pd.Series, counts: pd.Series, length: pd.Series) -> pd.Series:
    return pd.Series(
        [dense(np.asarray(s), np.asarray(c), int(n)) for s, c, n in zip(slots, counts, length, strict=True)]
    )


def dense_histogram(hist: DataFrame, borders: DataFrame) -> DataFrame:
    """``hist`` cut to the half-open ``borders(rg, lo, hi)`` as a dense ``values`` array."""
    entries = (
        hist.join(borders.select("rg", "lo", "hi"), "rg")
        .where((F.col("size") >= F.col("lo")) & (F.col("size") < F.col("hi")))
        .groupBy("rg", "lo", "hi")
        .agg(
            F.collect_list(F.struct((F.col("size") - F.col("lo")).alias("slot"), F.col("cnt").cast("double").alias("cnt"))).alias("e")
        )
    )
    return entries.select(
        "rg",
        F.col("lo").alias("offset"),
        _dense("e.slot", "e.cnt", F.col("hi") - F.col("lo")).alias("values"),
    )


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def smoothed(values: pd.Series) -> pd.Series:
    """Dense counts after kernel smoothing."""
    return values.map(lambda v: smooth(np.asarray(v)))


def quantile_distances(histograms: DataFrame, strict: bool = False) -> DataFrame:
    """Adds distances of the 1 % and 99 % quantiles from the median. Needs ``offset, values, median``."""

    @F.pandas_udf("lower_q bigint, upper_q bigint")
    def distances(values: pd.Series, offset: pd.Series, median: pd.Series) -> pd.DataFrame:
        rows = [
            [abs(int(o) + s - int(m)) for s in quantile_slots(np.asarray(v), strict)]
            for v, o, m in zip(values, offset, median, strict=True)
        ]
        return pd.DataFrame(rows, columns=["lower_q", "upper_q"], dtype="int64")

    return histograms.withColumn("_q", distances("values", "offset", "median")).select(
        *histograms.columns, "_q.lower_q", "_q.upper_q"
    )


def densities(
    histograms: DataFrame, fraction: int = 500, smoothing: bool = True, strict: bool = False
) -> DataFrame:
    """Counts to floored, window-corrected densities plus quantile distances.

    Needs ``rg, offset, values, median, read_len``; keeps other columns. Row-local: no shuffle.
    """

    @F.pandas_udf("values array<double>, min_prob double, lower_q bigint, upper_q bigint")
    def shaped(values: pd.Series, offset: pd.Series, median: pd.Series, read_len: pd.Series) -> pd.DataFrame:
        rows = [
            shape(np.asarray(v), int(o), int(m), int(n), fraction, smoothing, strict)
            for v, o, m, n in zip(values, offset, median, read_len, strict=True)
        ]
        return pd.DataFrame(rows, columns=["values", "min_prob", "lower_q", "upper_q"])

    rest = [c for c in histograms.columns if c != "values"]
    return histograms.withColumn("_d", shaped("values", "offset", "median", "read_len")).select(
        *rest, "_d.values", "_d.min_prob", "_d.lower_q", "_d.upper_q"
    )


def depth(pairs: Column, sampled_length: Column, read_len: Column) -> Column:
    """Average coverage by both reads of ``pairs`` pairs over the sampled length."""
    return pairs / sampled_length * read_len * 2


def coverage(hist: DataFrame, interval_length: Column, read_len: DataFrame) -> DataFrame:
    """Average coverage of each read group over the sampled intervals."""
    counts = hist.groupBy("rg").agg(F.sum("cnt").alias("n"))
    return counts.join(read_len.select("rg", "read_len"), "rg").select(
        "rg", "n", depth(F.col("n"), interval_length, F.col("read_len")).alias("coverage")
    )


def low_coverage(cov: DataFrame, minimum: float = 5.0) -> DataFrame:
    """Read groups whose coverage deserves a warning."""
    return cov.where(F.col("coverage") < minimum)


def sampling_stop(counts: DataFrame, groups: DataFrame, min_pairs: int, *by: str) -> DataFrame:
    """Interval index after which every read group (of a sample, with ``by``) has enough pairs.

    ``counts(rg, itv, cnt)`` has one row per read group and interval. ``last_itv`` is NULL when
    some group never gets there.
    """
    upto = F.sum("cnt").over(Window.partitionBy("rg").orderBy("itv"))
    reached = (
        counts.withColumn("upto", upto)
        .where(F.col("upto") >= min_pairs)
        .groupBy("rg")
        .agg(F.min("itv").alias("itv"))
    )
    return (
        groups.select("rg", *by).distinct()
        .join(reached, "rg", "left")
        .groupBy(*by)
        .agg(F.when(F.count(F.lit(1)) == F.count("itv"), F.max("itv")).alias("last_itv"))
    )


def initial_thresholds(rg_stats: DataFrame, min_init_len: int | None, factor: float = 4.0) -> DataFrame:
    """Smallest initial deletion length per read group: a constant or four standard deviations."""
    if min_init_len is not None:
        return rg_stats.withColumn("min_init_len", F.lit(min_init_len).cast("bigint"))
    return rg_stats.withColumn("min_init_len", round_half_up(F.lit(factor) * F.col("stddev")))


def cohort_scalars(thresholds: DataFrame) -> DataFrame:
    """Final minimum length (95th percentile of the initial ones) and mean standard deviation.

    The percentile runs over counts per distinct threshold, so the cohort is not gathered in one row.
    """
    counts = thresholds.groupBy("min_init_len").agg(
        F.count(F.lit(1)).alias("m"), F.sum("stddev").alias("s")
    )
    entries = counts.agg(
        F.array_sort(F.collect_list(F.struct(F.col("min_init_len").alias("dev"), F.col("m").alias("cnt")))).alias("e"),
        F.sum("m").alias("n"),
        (F.sum("s") / F.sum("m")).alias("mean_stddev"),
    )
    return entries.select(
        weighted_kth(F.col("e"), F.ceil(F.col("n") * F.lit(0.95)) - 1).alias("min_len"), "mean_stddev"
    )


def percentile_of(values: DataFrame, key: str, value: str, p: float) -> DataFrame:
    """Nearest-rank percentile per key, over counts per distinct value."""
    counts = values.groupBy(key, value).agg(F.count(F.lit(1)).alias("m"))
    whole = Window.partitionBy(key)
    upto = F.sum("m").over(whole.orderBy(value))
    goal = F.ceil(F.sum("m").over(whole) * F.lit(p))
    return (
        counts.withColumn("upto", upto)
        .withColumn("goal", goal)
        .where(F.col("upto") >= F.col("goal"))
        .groupBy(key)
        .agg(F.min(value).alias("pct"))
    )
