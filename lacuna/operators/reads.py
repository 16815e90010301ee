"""From alignment records to read pairs.

Records are filtered before anything moves; each side is reduced to one record per name on the map
side, so the mate join is one-to-one and no name can overload a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions import reads as R
from lacuna.operators.windows import profile_bin
from lacuna.params import ProfileParams


#: Width of the tiles in which records meet sampling intervals.
SAMPLING_TILE = 1_000_000


def name_keys(rows: DataFrame) -> list[str]:
    """Key of a read name; names are unique within a sample only."""
    return [*(["sample"] if "sample" in rows.columns else []), "qname", "contig"]


def last_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the greatest by ``order``. Combines before the shuffle."""
    return _extreme(rows, keys, order, F.max)


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return _extreme(rows, keys, order, F.min)


def _extreme(rows: DataFrame, keys: list[str], order: list[str], best) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys and c not in order]
    row = F.struct(*order, *rest)
    return rows.groupBy(*keys).agg(best(row).alias("_row")).select(*keys, "_row.*")


def max_insert_sizes(rg_stats: DataFrame, max_deletion: int) -> DataFrame:
    """Longest template per read group that still enters a profile."""
    limit = (F.col("median") + 2 * F.col("stddev") + max_deletion).cast("bigint")
    return rg_stats.withColumn("max_insert", limit)


def forward_mates(reads: DataFrame, rg_stats: DataFrame, params: ProfileParams) -> DataFrame:
    """Usable leftmost reads with the positions that define their pair."""
    limits = max_insert_sizes(rg_stats, params.max_deletion).select("rg", "max_insert")
    return (
        reads.where(~R.is_reverse(F.col("flag")) & R.passes(params.quality.forward()))
        .where(F.col("pos") <= F.col("mate_pos"))
        .join(limits, "rg")
        .where(F.col("tlen") <= F.col("max_insert"))
        .select(
            *name_keys(reads), "rg",
            F.col("pos").cast("bigint").alias("fwd_pos"),
            F.col("mate_pos").cast("bigint").alias("fwd_mate_pos"),
            (F.col("pos") + R.reference_length(F.col("cigar"))).cast("bigint").alias("inner_begin"),
            R.insert_begin(F.col("pos"), F.col("cigar")).cast("bigint").alias("insert_begin"),
        )
    )


def reverse_mates(reads: DataFrame, params: ProfileParams) -> DataFrame:
    """Usable rightmost reads."""
    return (
        reads.where(R.is_reverse(F.col("flag")) & R.passes(params.quality.reverse()))
        .where(F.col("pos") >= F.col("mate_pos"))
        .select(
            *name_keys(reads),
            F.col("rg").alias("rev_rg"),
            F.col("pos").cast("bigint").alias("rev_pos"),
            R.insert_end(F.col("pos"), F.col("cigar")).cast("bigint").alias("insert_end"),
        )
    )


def pair_mates(forward: DataFrame, reverse: DataFrame) -> DataFrame:
    """Joins the last forward with the first reverse read of a name on the same contig."""
    keys = name_keys(forward)
    left = last_of(forward, keys, ["fwd_pos", "inner_begin", "insert_begin"])
    right = first_of(reverse, keys, ["rev_pos", "insert_end"])
    return left.join(right, keys).where(F.col("fwd_pos") <= F.col("rev_pos"))


def reads_in_regions(forward: DataFrame, regions: DataFrame) -> DataFrame:
    """Forward reads that start before a region's end and whose mate starts at or after its start."""
    touching = (F.col("fwd_pos") < F.col("r_end")) & (F.col("fwd_mate_pos") >= F.col("r_beg"))
    tile = 1_000_000
    tiles = lambda lo, hi: F.explode(
        F.sequence(F.floor(lo / tile), F.greatest(F.floor(lo / tile), F.floor(hi / tile)))
    )
    tiled = regions.select(
        "contig", F.col("beg").alias("r_beg"), F.col("end").alias("r_end"),
        tiles(F.col("beg"), F.col("end")).alias("_tile"),
    )
    spread = forward.withColumn("_tile", tiles(F.col("fwd_pos"), F.col("fwd_mate_pos")))
    return (
        spread.join(tiled, ["contig", "_tile"]).where(touching).drop("_tile", "r_beg", "r_end").distinct()
    )


def read_pairs(
    reads: DataFrame, rg_stats: DataFrame, params: ProfileParams, regions: DataFrame | None = None
) -> DataFrame:
    """``pairs(contig, rg, start, isize)`` of one or many samples."""
    forward = forward_mates(reads, rg_stats, params)
    if regions is not None:
        forward = reads_in_regions(forward, regions)
    mates = pair_mates(forward, reverse_mates(reads, params))
    return mates.select(
        "contig",
        F.col("rev_rg").alias("rg"),
        F.col("inner_begin").alias("start"),
        (F.col("insert_end") - F.col("insert_begin")).alias("isize"),
    )


def sampled_sizes(reads: DataFrame, intervals: DataFrame, params: ProfileParams) -> DataFrame:
    """Forward reads inside the sampling intervals: ``(rg, itv, pos, qname, size, read_len)``.

    A record at the interval's end position still counts. Records meet intervals by tile, so a contig with very many of
    either is spread.
    """
    from lacuna.operators.histograms import capped_size

    gated = reads.where(R.passes(params.quality) & (F.col("pos") <= F.col("mate_pos")))
    tile = lambda p: F.floor(p / F.lit(SAMPLING_TILE))
    tiled = intervals.select(
        "itv", "contig", "beg", "end", F.explode(F.sequence(tile(F.col("beg")), tile(F.col("end")))).alias("_tile")
    )
    return (
        gated.withColumn("_tile", tile(F.col("pos")))
        .join(tiled, ["contig", "_tile"])
        .where((F.col("pos") >= F.col("beg")) & (F.col("pos") <= F.col("end")))
        .select(
            "rg", "itv", "pos", "qname",
            capped_size(F.col("tlen"), params.max_size).alias("size"),
            R.read_length(F.col("l_seq"), F.col("cigar")).cast("bigint").alias("read_len"),
        )
    )


def _group_keys(rows: DataFrame, rg_stats: DataFrame) -> list[str]:
    """Read groups are known by sample and identifier, where both sides name the sample."""
    return ["sample", "rg"] if "sample" in rows.columns and "sample" in rg_stats.columns else ["rg"]


def to_profile(pairs: DataFrame, rg_stats: DataFrame) -> DataFrame:
    """``profile(contig, win, [sample,] rg, off, dev)``: pairs by 256-bp window, deviations from the median."""
    win = profile_bin(F.col("start"))
    keys = _group_keys(pairs, rg_stats)
    named = ["sample", "rg"] if "sample" in rg_stats.columns else ["rg"]
    return pairs.join(rg_stats.select(*named, "median"), keys).select(
        "contig", win.alias("win"), *named,
        (F.col("start") - win).alias("off"),
        (F.col("isize") - F.col("median")).alias("dev"),
    )


def from_profile(profile: DataFrame, rg_stats: DataFrame) -> DataFrame:
    """Back to ``pairs(contig, [sample,] rg, start, isize)``."""
    keys = _group_keys(profile, rg_stats)
    return profile.join(rg_stats.select(*keys, "median"), keys).select(
        "contig", *keys,
        (F.col("win") + F.col("off")).alias("start"),
        (F.col("dev") + F.col("median")).alias("isize"),
    )
