"""Insert-size densities held as one dense array per read group.

Index ``i`` of the array stands for insert size ``offset + i``. The first and the last slot are
reserved for irregular sizes and never looked up. Arrays are shaped with NumPy, one read group at a
time; lookups stay in the JVM.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from lacuna.params import PROFILE_WINDOW

# Half width and scale of the smoothing kernel.
SMOOTH_REACH = 20
SMOOTH_SCALE = 40.0

KERNEL = [math.exp(-(j * j) / SMOOTH_SCALE) for j in range(-SMOOTH_REACH, SMOOTH_REACH + 1)]
KERNEL_SUM = sum(KERNEL)

# Shares at which the quantile distances are taken.
LOWER_SHARE = 0.01
UPPER_SHARE = 0.99


def dense(slots: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    values = np.zeros(length)
    values[slots] = counts
    return values


def smooth(values: np.ndarray) -> np.ndarray:
    """Weighted average of the neighbours; the full kernel weight divides also at the borders."""
    full = np.convolve(values, KERNEL)
    return full[SMOOTH_REACH : SMOOTH_REACH + len(values)] / KERNEL_SUM


def total(values: np.ndarray, truncate: bool = False) -> float:
    """Sum of the values; ``truncate`` drops the fraction after every addition."""
    if not truncate:
        return float(values.sum())
    running = 0
    for v in values.tolist():
        running = int(running + v)
    return float(running)


def quantile_slots(values: np.ndarray, strict: bool = False) -> tuple[int, int]:
    """First regular slots at which the running count reaches the two quantile shares.

    ``strict`` truncates the total and counts the slot of the lower quantile twice.
    """
    inner = values[1:-1]
    whole = total(inner, strict)
    upto = np.cumsum(inner)
    last = len(inner) - 1
    low = min(int(np.searchsorted(upto, whole * LOWER_SHARE)), last)
    if strict:
        doubled = upto[low:] + inner[low]
        high = min(low + int(np.searchsorted(doubled, whole * UPPER_SHARE)), last)
    else:
        high = min(int(np.searchsorted(upto, whole * UPPER_SHARE)), last)
    return low + 1, high + 1


def normalise(values: np.ndarray, offset: int, read_len: int) -> np.ndarray:
    """Corrects for the number of windows a pair of a given size reaches.

    Slot 1 is treated as size ``offset`` (one less than its nominal size).
    """
    out = values.copy()
    i = np.arange(1, len(values) - 1)
    inner = np.maximum(1, offset + i - 1 - 2 * read_len)
    out[1:-1] *= (PROFILE_WINDOW + inner - 1) / PROFILE_WINDOW
    return out


def shape(
    values: np.ndarray, offset: int, median: int, read_len: int, fraction: int, smoothing: bool, strict: bool
) -> tuple[np.ndarray, float, int, int]:
    """Counts to ``(density, minimum, lower and upper quantile distance)``."""
    counts = smooth(values) if smoothing else values
    low, high = quantile_slots(counts, strict)
    scaled = normalise(counts / total(counts, strict), offset, read_len)
    minimum = float(scaled.max()) / fraction
    return np.maximum(scaled, minimum), minimum, abs(offset + low - median), abs(offset + high - median)


def lookup(values: Column, minimum: Column, offset: Column, median: Column, dev: Column) -> Column:
    """Density of a deviation from the median; the minimum outside the regular slots."""
    i = (dev + median - offset).cast("int")
    return F.when((i <= 0) | (i + 1 >= F.size(values)), minimum).otherwise(F.get(values, i))
