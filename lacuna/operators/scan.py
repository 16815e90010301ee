"""Running aggregates along a contig without one task per contig.

A window over ``contig`` alone sorts a whole contig in one task. Here positions are cut into tiles:
each tile is reduced, the carry runs over the few tiles, and the exact running value is finished
inside the tile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_max(
    df: DataFrame, keys: list[str], pos: str, value: Column, order: list[Column], tile: int, out: str
) -> DataFrame:
    """Adds the maximum of ``value`` over all earlier rows of the key; NULL on the first row.

    ``order`` sorts rows within a tile and must start with ``pos``.
    """
    tiled = df.withColumn("_tile", F.floor(F.col(pos) / F.lit(tile))).withColumn("_v", value)
    reduced = tiled.groupBy(*keys, "_tile").agg(F.max("_v").alias("_m"))
    before = Window.partitionBy(*keys).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    carry = reduced.withColumn("_carry", F.max("_m").over(before)).drop("_m")
    inside = Window.partitionBy(*keys, "_tile").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1
    )
    return (
        tiled.join(carry, [*keys, "_tile"])
        .withColumn(out, F.greatest(F.max("_v").over(inside), F.col("_carry")))
        .drop("_tile", "_v", "_carry")
    )


def islands(
    df: DataFrame, keys: list[str], beg: str, end: Column, order: list[Column], tile: int, gap: int = 0
) -> DataFrame:
    """Adds ``island``: start of the run of rows in which none begins beyond the reach before it."""
    reach = running_max(df, keys, beg, end, order, tile, "_reach")
    opens = F.col("_reach").isNull() | (F.col(beg) > F.col("_reach") + gap)
    marked = reach.withColumn("_open", F.when(opens, F.col(beg)))
    last = running_max(marked, keys, beg, F.col("_open"), order, tile, "_last")
    return last.withColumn("island", F.coalesce(F.col("_open"), F.col("_last"))).drop(
        "_reach", "_open", "_last"
    )
