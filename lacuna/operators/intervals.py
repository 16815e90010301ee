"""Intervals: reading, merging, ordering, tiling, membership."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions.regions import fill_open, parse_region
from lacuna.operators.scan import islands
from lacuna.params import PROFILE_WINDOW, ParameterError

#: Tile of the running maximum when merging; intervals per tile are sorted together.
MERGE_TILE = 1_000_000

# Default sampling intervals per build as (contig number, first, last) in 1-based
# closed coordinates. Each build names its contigs with the given prefix.
SAMPLING_GRCH38 = {
    1: (35000000, 36000000), 2: (174000000, 175000000), 3: (36500000, 37500000),
    4: (88000000, 89000000), 5: (38000000, 39000000), 6: (38000000, 39000000),
    7: (38000000, 39000000), 8: (19000000, 20000000), 9: (19000000, 20000000),
    10: (19000000, 20000000), 11: (19000000, 20000000), 12: (19000000, 20000000),
    13: (25000000, 26000000), 14: (25000000, 26000000), 15: (25000000, 26000000),
    16: (25000000, 26000000), 17: (31000000, 32000000), 18: (31000000, 32000000),
    19: (31000000, 32000000), 20: (33000000, 34000000), 21: (21000000, 22000000),
    22: (25000000, 26000000),
}
SAMPLING_GRCH37 = SAMPLING_GRCH38 | {
    7: (37000000, 38000000), 13: (30000000, 31000000), 14: (26000000, 27000000),
    15: (26000000, 27000000), 22: (34000000, 35000000),
}
SAMPLING_T2T = {
    1: (34862671, 35862889), 2: (174486328, 175488756), 3: (36501211, 37501538),
    4: (91326486, 92331326), 5: (38249055, 39249508), 6: (37824746, 38824389),
    7: (37140330, 38140895), 8: (19264816, 20265041), 9: (19012888, 20013866),
    10: (19019031, 20018540), 11: (19120148, 20120642), 12: (18876696, 19878375),
    13: (29222575, 30221906), 14: (20198012, 21197787), 15: (23740521, 24741559),
    16: (25279621, 26276377), 17: (31945727, 32945877), 18: (31190236, 32190327),
    19: (33518257, 34518549), 20: (34726695, 35726351), 21: (19362386, 20367614),
    22: (34457342, 35458830),
}
SAMPLING = {
    "grch38": ("chr", SAMPLING_GRCH38),
    "hg38": ("chr", SAMPLING_GRCH38),
    "grch37": ("", SAMPLING_GRCH37),
    "hg19": ("chr", SAMPLING_GRCH37),
    "t2t": ("chr", SAMPLING_T2T),
}


def sampling_intervals(spark: SparkSession, build: str) -> DataFrame:
    """Default intervals ``(contig, beg, end)`` for estimating insert-size statistics."""
    prefix, table = SAMPLING[build.lower()]
    rows = [(f"{prefix}{n}", first - 1, last) for n, (first, last) in table.items()]
    return spark.createDataFrame(rows, "contig string, beg bigint, end bigint")


def default_sampling(spark: SparkSession, build: str, rois: DataFrame) -> DataFrame:
    """Default intervals on the contigs of the regions of interest; an error when there are none."""
    kept = on_contigs(sampling_intervals(spark, build), rois)
    if kept.isEmpty():
        raise ParameterError(
            "no contig of the regions of interest has a default sampling interval; "
            "choose another reference build or give sampling intervals"
        )
    return kept


def on_contigs(intervals: DataFrame, contigs: DataFrame) -> DataFrame:
    return intervals.join(contigs.select("contig"), "contig", "left_semi")


def unknown_contigs(intervals: DataFrame, contigs: DataFrame) -> DataFrame:
    """Intervals that lie on no known contig."""
    return intervals.join(contigs.select("contig"), "contig", "left_anti")


def parse_regions(texts: DataFrame, column: str = "value") -> DataFrame:
    """Text rows to intervals with open ends as NULL; raises on the first invalid text when run."""
    region = F.coalesce(
        parse_region(F.col(column)),
        F.raise_error(F.concat(F.lit("invalid genomic region: "), F.coalesce(F.col(column), F.lit("")))).cast(
            "struct<contig:string,beg:bigint,end:bigint>"
        ),
    )
    return texts.select(region.alias("r")).select("r.contig", "r.beg", "r.end")


def whole_contigs(contigs: DataFrame) -> DataFrame:
    return contigs.select("contig", F.lit(0).cast("bigint").alias("beg"), F.col("len").alias("end"))


def close_intervals(intervals: DataFrame, contigs: DataFrame) -> DataFrame:
    """Fills open ends from the contig lengths."""
    beg, end = fill_open(F.col("beg"), F.col("end"), F.col("len"))
    return (
        intervals.join(contigs.select("contig", "len"), "contig", "left")
        .withColumns({"beg": beg, "end": end})
        .drop("len")
    )


def expand(intervals: DataFrame, by: int) -> DataFrame:
    return intervals.withColumns(
        {"beg": F.greatest(F.lit(0).cast("bigint"), F.col("beg") - by), "end": F.col("end") + by}
    )


def merge_intervals(intervals: DataFrame, max_gap: int = 0, tile: int = MERGE_TILE) -> DataFrame:
    """Unites intervals of a contig that overlap, touch or lie within ``max_gap`` of each other."""
    grouped = islands(
        intervals.select("contig", "beg", "end"), ["contig"], "beg", F.col("end"),
        [F.col("beg"), F.col("end")], tile, max_gap,
    )
    return grouped.groupBy("contig", "island").agg(
        F.min("beg").alias("beg"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n_merged")
    ).drop("island")


def regions_of_interest(texts: DataFrame | None, contigs: DataFrame, max_gap: int = 0) -> DataFrame:
    """Merged regions with their contig rank. Without texts every contig is a region."""
    if texts is None:
        rois = whole_contigs(contigs)
    else:
        parsed = parse_regions(texts)
        missing = unknown_contigs(parsed, contigs).first()
        if missing is not None:
            raise ParameterError(f"contig {missing['contig']!r} is not part of the reference")
        rois = merge_intervals(close_intervals(parsed, contigs), max_gap)
    return in_contig_order(rois, contigs).select("contig", "contig_id", "beg", "end")


def in_contig_order(intervals: DataFrame, contigs: DataFrame) -> DataFrame:
    """Adds ``contig_id`` of the header order; sort by ``(contig_id, beg)`` at the sink."""
    return intervals.join(contigs.select("contig", "contig_id"), "contig")


def chunks(contigs: DataFrame, size: int, padding: int = 0) -> DataFrame:
    """Tiles every contig into chunks with right padding."""
    return (
        contigs.select("contig", "len", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("len") / size))).alias("i"))
        .select(
            "contig",
            (F.col("i") * size).alias("beg"),
            F.least(F.col("i") * size + size + padding, F.col("len")).alias("end"),
        )
    )


def windows_in_regions(rows: DataFrame, window: str, regions: DataFrame) -> DataFrame:
    """Rows whose window start lies in a region.

    Regions are tiled so that membership becomes an equi-join; regions must not overlap.
    """
    tile = MERGE_TILE
    tiled = regions.select(
        "contig", "beg", "end",
        F.explode(
            F.sequence(
                F.floor(F.col("beg") / tile),
                F.greatest(F.floor(F.col("beg") / tile), F.floor((F.col("end") - 1) / tile)),
            )
        ).alias("_tile"),
    )
    return (
        rows.withColumn("_tile", F.floor(F.col(window) / tile))
        .join(tiled, ["contig", "_tile"])
        .where((F.col(window) >= F.col("beg")) & (F.col(window) < F.col("end")))
        .drop("_tile", "beg", "end")
    )


def index_regions(contigs: DataFrame, region_size: int) -> DataFrame:
    """Number of index regions per contig."""
    return contigs.select("contig", (F.floor(F.col("len") / region_size) + 1).alias("n_regions"))
