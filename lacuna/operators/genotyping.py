"""Estimation of deletion length, allele frequency and genotypes per grid point.

Run-length observations are dealt over parts by grid point and solved in memory, many candidates at once.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lacuna.functions import genotype as G
from lacuna.operators import em
from lacuna.operators.cohort_blocks import genotype_in_blocks
from lacuna.operators.em_kernel import ReadGroups, Settings, kernel, shared_read_groups
from lacuna.operators.windows import GRID_TILE, grid_bin, grid_tiles, support_positions
from lacuna.session import materialise

#: Samples of which one task holds the densities.
BLOCK_SAMPLES = 1024
SCALARS = ["offset", "min_prob", "median", "stddev", "lower_q", "upper_q"]
COUNTS = ["lad_ref", "lad_amb", "lad_del", "dad_ref", "dad_both", "dad_between", "dad_alt", "dad_right"]


def genotype_schema(observed: DataFrame) -> T.StructType:
    """Schema of genotyped grid points: one row per candidate and sample with data."""
    big, dbl = T.LongType(), T.DoubleType()
    fields = [
        ("contig", T.StringType()), ("p", big), ("len0", big), ("iterations", big), ("len", big),
        ("lr", dbl), ("af", dbl), ("data_samples", big), ("lead", T.BooleanType()),
        ("sample", observed.schema["sample"].dataType), ("first", big), ("last", big),
        ("pl0", big), ("pl1", big), ("pl2", big), *[(c, big) for c in COUNTS],
    ]
    return T.StructType([T.StructField(n, t) for n, t in fields])


def candidate_observations(loaded: DataFrame, candidates: DataFrame) -> DataFrame:
    """Observations of the grid points with candidates, once per candidate length."""
    return loaded.select(
        "contig", "p", "sample", "rg", "dev", "cnt", "first", "last", "high_cov"
    ).join(candidates, ["contig", "p"])


def genotype_windows(
    observed: DataFrame, density: DataFrame, settings: Settings, block_samples: int = BLOCK_SAMPLES
) -> DataFrame:
    """Solves candidates, in one pass up to ``block_samples`` samples and over blocks of as many beyond.

    Grid points are dealt over parts. Every part gets the densities once, as rows of their own that sort before
    its observations, so no array is repeated per candidate and nothing is broadcast. A candidate holds at most
    one observation per read group and distinct deviation below the load limit.
    """
    schema = genotype_schema(observed)
    # one array per read group, its scalars first: cheap to leave out of the rows of observations
    stats = density.select(
        "rg", "stddev", F.concat(F.array(*[F.col(c).cast("double") for c in SCALARS]), "values").alias("stats")
    )
    if settings.n_samples > block_samples:
        return genotype_in_blocks(observed, stats, schema, settings, block_samples)
    arrow = to_arrow_schema(schema)
    parts = int(observed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = observed.withColumn("part", F.pmod(F.xxhash64("contig", "p"), F.lit(parts)).cast("int"))
    arrays = stats.select("rg", "stats", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    rows = dealt.unionByName(arrays, allowMissingColumns=True)

    def run(batches):
        resolve, rest = densities_first(batches)
        yield from kernel(resolve, arrow, settings)(rest)

    return (
        rows.repartitionById(parts, "part")
        .sortWithinPartitions(F.col("stats").isNull(), "contig", "p", "len0", "sample", "rg", "dev")
        .mapInArrow(run, schema)
    )


def densities_first(batches: Iterator[pa.RecordBatch]) -> tuple[Callable, Iterator[pa.RecordBatch]]:
    """The read groups of a part, which lead its stream, and the rest of the stream."""
    found: list[pa.RecordBatch] = []
    rest = iter(batches)
    for batch in rest:
        cut = int(batch.column("stats").is_valid().to_numpy(zero_copy_only=False).sum())
        found.append(batch.slice(0, cut).select(["rg", "stats"]))
        if cut < batch.num_rows:
            rest = itertools.chain([batch.slice(cut)], rest)
            break
    return (shared_read_groups(*_densities(found)) if found else None), rest


def _densities(batches: list[pa.RecordBatch]) -> tuple[list, dict]:
    """Read groups with their statistics and densities, each once."""
    table = pa.Table.from_batches(batches)
    position = {rg: i for i, rg in enumerate(table["rg"].to_pylist())}
    lists = [table["stats"][i].values.to_numpy() for i in position.values()]
    scalars = np.array([x[: len(SCALARS)] for x in lists]).reshape(-1, len(SCALARS))
    slots = np.array([len(x) - len(SCALARS) for x in lists], dtype=np.int64)
    offset, min_prob, median, stddev, lower_q, upper_q = scalars.T
    groups = ReadGroups(
        flat=np.concatenate([x[len(SCALARS) :] for x in lists]) if lists else np.zeros(0),
        base=np.cumsum(slots) - slots,
        slots=slots,
        rebase=median.astype(np.int64) - offset.astype(np.int64),
        min_prob=min_prob,
        stddev=stddev,
        lower_q=lower_q.astype(np.int64),
        upper_q=upper_q.astype(np.int64),
    )
    return list(position), vars(groups)


# ---------------------------------------------------------------- from candidates to window calls


def supported(
    genotyped: DataFrame, spanned: DataFrame, hot: DataFrame, rg_stats: DataFrame
) -> DataFrame:
    """Window calls with the positions their supporting pairs point at; unsupported ones drop out.

    ``hot(contig, p, rg)`` lists saturated read groups, which do not support anything. Spans meet the calls by
    tile of the grid; nothing is exploded to grid points.
    """
    lead = genotyped.where("lead").select(*em.KEY, "len", F.floor(F.col("p") / F.lit(GRID_TILE)).alias("tile"))
    borders = rg_stats.select("rg", "lower_q", "upper_q")
    support = (
        grid_tiles(spanned, "rg", "start", "dev", "end_pos")
        .join(lead, ["contig", "tile"])
        .where(F.col("p").between(F.col("g_beg"), F.col("g_end")))
        .join(borders, "rg")
        .where(
            (F.col("dev") >= F.col("len") - F.col("lower_q"))
            & (F.col("dev") <= F.col("len") + F.col("upper_q"))
        )
        .join(hot, ["contig", "p", "rg"], "left_anti")
        .groupBy(*em.KEY, "start", "end_pos")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return support_positions(materialise(support), em.KEY).where((F.col("pos") != 0) | (F.col("end_pos") != 0))


def window_calls(
    genotyped: DataFrame, positions: DataFrame, n_samples: int, min_sample_fraction: float,
    window_wise: bool = False,
) -> DataFrame:
    """Slim table of calls, one row per grid point and candidate, without per-sample data."""
    lead = genotyped.where("lead").select(*em.KEY, "iterations", "len", "lr", "af", "data_samples")
    enough = F.col("data_samples") / F.lit(n_samples) >= min_sample_fraction
    calls = (
        lead.join(positions, em.KEY)
        .withColumn("win_pos", F.col("p") - 1)
        .withColumn("filter", F.when(enough, F.lit(0)).otherwise(F.lit(G.FILTER_SAMPLES)).cast("bigint"))
        .drop("data_samples")
    )
    if window_wise:
        calls = calls.withColumn("pos", F.col("win_pos")).withColumn("end_pos", F.lit(0).cast("bigint"))
    return calls


def first_grid_points(spanned: DataFrame) -> DataFrame:
    """Grid bin of the first pair per contig."""
    return spanned.groupBy("contig").agg(F.min(grid_bin(F.col("start"))).alias("first_p"))


def with_segments(calls: DataFrame, firsts: DataFrame, size: int) -> DataFrame:
    """Adds the segment within which calls are merged."""
    return calls.join(firsts, "contig").withColumn(
        "segment", F.floor((F.col("p") - F.col("first_p")) / F.lit(size)).cast("bigint")
    ).drop("first_p")


def sample_order(samples: DataFrame) -> DataFrame:
    """Samples with their column number. One row per sample, so one ordered window is enough."""
    return samples.select("sample").distinct().withColumn(
        "column", (F.row_number().over(Window.orderBy("sample")) - 1).cast("bigint")
    )
