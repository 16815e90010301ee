"""Admission of read pairs under a load limit per read group.

Pairs arrive ordered by position. A read group whose open pairs reach its limit takes no further
pair until enough have ended. Whether a pair enters depends on all before it, so the rule is a
state machine; its state is the sorted ends of at most ``limit`` open pairs.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from lacuna.operators.scan import islands
from lacuna.operators.windows import grid_bin
from lacuna.params import GRID_STEP
from lacuna.session import materialise

#: Tile of the running maximum that finds the places where no pair is open.
ISLAND_TILE = 100_000

#: Positions of one tile of the admission; a whole number of grid steps.
ADMISSION_TILE = 30_000 * GRID_STEP
TILE = ["contig", "rg", "island", "tile"]


def admit(opened: list[int], start: int, last_win: int, limit: int) -> bool:
    """Closes ended pairs and admits the new one if there is room. ``opened`` is a heap of ends."""
    window = start // GRID_STEP * GRID_STEP
    while opened and opened[0] < window:
        heapq.heappop(opened)
    if len(opened) >= limit:
        return False
    heapq.heappush(opened, last_win)
    return True


def admitted_pairs(spanned: DataFrame, max_load: DataFrame | None, default_load: int, tile: int = ADMISSION_TILE) -> DataFrame:
    """Pairs that get in, for complete input.

    Runs are cut wherever nothing is open. Runs too small to reach the limit pass as they are. The others are cut into tiles
    of positions, and all tiles run in parallel from an assumed set of open ends: first from none, then again
    those whose assumption differs from what the tile before left open, until all agree. Every round settles at least the first
    tile that was not settled yet, so the outcome is that of one ordered pass; since ends close within a template's
    length, what enters a tile mostly no longer shows at its end, and few rounds do. No task holds more than the open
    ends of a tile and one batch of its pairs.
    """
    columns = spanned.columns
    if max_load is None:
        limited = spanned.withColumn("max_load", F.lit(default_load).cast("bigint"))
    else:
        limited = spanned.join(max_load.select("rg", "max_load"), "rg", "left").withColumn(
            "max_load", F.coalesce("max_load", F.lit(default_load).cast("bigint"))
        )
    begun = limited.withColumn("begin", grid_bin(F.col("start")))
    cut = islands(
        begun, ["contig", "rg"], "begin", F.col("last_win"),
        [F.col("begin"), F.col("start"), F.col("dev")], ISLAND_TILE,
    )
    sizes = cut.groupBy("contig", "rg", "island").agg(F.count(F.lit(1)).alias("_n"))
    sized = cut.join(sizes, ["contig", "rg", "island"])
    free = sized.where(F.col("_n") <= F.col("max_load")).select(*columns)
    tight = materialise(
        sized.where(F.col("_n") > F.col("max_load")).withColumn("tile", F.floor(F.col("begin") / tile)).drop("_n", "begin"), "tight"
    )
    opened = settled_tiles(tight, tile)
    return free.unionByName(_walk(tight, opened, tight.select(*columns).schema, columns))


def settled_tiles(tight: DataFrame, tile: int) -> DataFrame:
    """(contig, rg, island, tile, incoming, opened): the ends open when each tile begins and when it ends, stored."""
    none = F.array().cast("array<bigint>")
    schema = tight.select(*TILE, none.alias("opened")).schema
    known = tight.select(*TILE).distinct().withColumn("incoming", none)
    states = materialise(known.join(_walk(tight, known, schema, None), TILE), "tiles")
    before = Window.partitionBy("contig", "rg", "island").orderBy("tile")
    while True:
        left = F.coalesce(F.lag("opened").over(before), none)
        # what ends before the tile begins does not matter there
        told = states.withColumn("due", F.array_sort(F.filter(left, lambda end: end >= F.col("tile") * tile)))
        wrong = materialise(told.where(F.col("due") != F.col("incoming")).select(*TILE, F.col("due").alias("incoming")), "wrong")
        if wrong.isEmpty():
            return states
        again = wrong.join(_walk(tight.join(wrong.select(*TILE), TILE, "left_semi"), wrong, schema, None), TILE)
        new = again.select(*TILE, F.col("incoming").alias("_in"), F.col("opened").alias("_open"))
        states = materialise(
            states.join(new, TILE, "left").select(
                *TILE, F.coalesce("_in", "incoming").alias("incoming"), F.coalesce("_open", "opened").alias("opened")
            ),
            "tiles",
        )


def _walk(tight: DataFrame, states: DataFrame, schema: StructType, kept: list[str] | None) -> DataFrame:
    """Every tile's pairs in order, from its incoming ends: the pairs that get in, or (``kept`` None) the ends left open."""
    rows = tight.withColumn("_pair", F.lit(1)).withColumn("incoming", F.lit(None).cast("array<bigint>"))
    heads = states.select(*TILE, "incoming", F.lit(0).alias("_pair"))
    both = rows.unionByName(heads, allowMissingColumns=True).repartition(*TILE).sortWithinPartitions(*TILE, "_pair", "start", "dev")
    named = [f.name for f in schema]
    whole = {f.name: "int64" for f in schema if f.dataType.typeName() in ("long", "integer")}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, opened = None, []

        def left() -> pd.DataFrame:
            return pd.DataFrame([(*key, sorted(opened))], columns=named)

        for pdf in frames:
            keep = np.zeros(len(pdf), bool)
            pairs = pdf["_pair"].to_numpy()
            starts, ends, limits = ([int(x) if x == x else 0 for x in pdf[c]] for c in ("start", "last_win", "max_load"))
            begin = 0
            for head in [*np.flatnonzero(pairs == 0).tolist(), len(pdf)]:
                for i in range(begin, head):
                    keep[i] = admit(opened, starts[i], ends[i], limits[i])
                begin = head + 1
                if head < len(pdf):
                    if key is not None and kept is None:
                        yield left()
                    key, opened = tuple(pdf[c].iloc[head] for c in TILE), [int(x) for x in pdf["incoming"].iloc[head]]
            if kept is not None:
                yield pdf.loc[keep, kept].astype({c: t for c, t in whole.items() if c in kept})
        if key is not None and kept is None:
            yield left()

    return both.mapInPandas(run, schema)


def admit_stream(spanned: DataFrame, limit: int) -> DataFrame:
    """Same rule on a stream of ``(contig, rg, start, dev, last_win)`` in position order."""
    schema = "contig string, rg string, start bigint, dev bigint, last_win bigint"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened = list(state.get[0]) if state.exists else []
        # A micro-batch brings the next stretch of positions; pairs within it may be shuffled.
        batch = pd.concat(list(frames)).sort_values(["start", "dev"])
        keep = [admit(opened, s, w, limit) for s, w in zip(batch["start"], batch["last_win"], strict=True)]
        state.update((sorted(opened),))
        yield batch.loc[keep, ["contig", "rg", "start", "dev", "last_win"]]

    return spanned.groupBy("contig", "rg").applyInPandasWithState(
        step, schema, "opened array<bigint>", "append", GroupStateTimeout.NoTimeout
    )
