"""Order statistics over arrays, plain and run-length weighted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column) -> Column:
    """``floor(x + 0.5)``; unlike ``round`` this sends -2.5 to -2."""
    return F.floor(x + F.lit(0.5)).cast("bigint")


def weighted_kth(entries: Column, k: Column) -> Column:
    """0-based k-th value of a sorted array of ``(dev, cnt)`` structs."""
    start = F.struct(
        F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("bigint").alias("val")
    )

    def step(acc: Column, x: Column) -> Column:
        seen = acc["seen"] + x["cnt"]
        hit = acc["val"].isNull() & (seen > k)
        return F.struct(
            seen.alias("seen"), F.when(hit, x["dev"].cast("bigint")).otherwise(acc["val"]).alias("val")
        )

    return F.aggregate(entries, start, step, lambda acc: acc["val"])


def upper_quartile_rank(n: Column) -> Column:
    """Fractional 0-based rank of the third quartile for n >= 4 values."""
    return (3.0 * n + 2.0 + n % 2) / 4.0 - 1.0


def upper_median(values: Column) -> Column:
    """Element ``n div 2`` of a sorted array."""
    return F.get(values, F.floor(F.size(values) / 2).cast("int"))


def padded_upper_median(values: Column, n: Column) -> Column:
    """Upper median of ``n`` values of which only the non-absent ones are listed.

    Absent values count as zero; listed values are non-negative and sorted.
    """
    index = F.floor(n / 2).cast("int") - (n - F.size(values)).cast("int")
    return F.when(index < 0, F.lit(0)).otherwise(F.get(values, index)).cast("bigint")
