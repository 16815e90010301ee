"""The ``view`` command: profiles as text, or rewritten with another layout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions.regions import chunk_file_name
from lacuna.operators import intervals, render
from lacuna.params import ViewParams
from lacuna.sources.profiles import Profile


def _groups(profile: Profile) -> list[str]:
    """Read groups of the viewed samples, in name order; the command shows one sample."""
    return [r["rg"] for r in profile.read_groups.select("rg").distinct().orderBy("rg").collect()]


def _region(profile: Profile, text: str) -> DataFrame:
    spark = profile.pairs.sparkSession
    return intervals.regions_of_interest(spark.createDataFrame([(text,)], "value string"), profile.contigs)


def pairs_in_view(profile: Profile, region: str | None) -> DataFrame:
    """Pairs of the windows that start inside the region.

    A pair inside the region whose window starts before it is not shown.
    """
    if region is None:
        return profile.pairs
    return intervals.windows_in_regions(
        profile.pairs, "win", _region(profile, region).select("contig", "beg", "end")
    )


def header(profile: Profile) -> list[str]:
    contigs = profile.contigs.orderBy("contig_id").collect()
    return render.header_lines(_groups(profile), [(r["contig"], r["len"]) for r in contigs])


def histogram_text(profile: Profile) -> tuple[list[str], DataFrame]:
    """Header lines and one row per insert size."""
    groups = _groups(profile)
    stats = profile.read_groups.select("rg", "median", "stddev", "read_len").collect()
    borders = profile.read_groups.select("rg", "lo", "hi")
    return render.histogram_header(stats, groups), render.histogram_lines(profile.hist, borders, groups)


def window_text(profile: Profile, region: str | None = None) -> DataFrame:
    return render.profile_lines(pairs_in_view(profile, region), _groups(profile))


def chunk_pairs(profile: Profile, out: str, size: int, padding: int = 0, contig: str | None = None) -> DataFrame:
    """Pairs with the name of every chunk that holds their window; padded chunks overlap."""
    contigs = profile.contigs if contig is None else profile.contigs.where(F.col("contig") == contig)
    parts = intervals.chunks(contigs, size, padding).withColumn(
        "file", chunk_file_name(F.lit(out), F.col("contig"), F.col("beg"), F.col("end"))
    )
    # A window lies in its own chunk and in the earlier ones whose padding still reaches it.
    reach = (padding + size - 1) // size
    own = F.floor(F.col("win") / size)
    spread = profile.pairs.withColumn(
        "_i", F.explode(F.sequence(F.greatest(F.lit(0).cast("bigint"), own - reach), own))
    )
    return (
        spread.join(parts.withColumn("_i", F.floor(F.col("beg") / size)), ["contig", "_i"])
        .where((F.col("win") >= F.col("beg")) & (F.col("win") < F.col("end")))
        .drop("_i", "beg", "end")
    )


def write_chunks(profile: Profile, params: ViewParams) -> None:
    """Rewrites a profile as one directory per chunk, or as a whole without a chunk size."""
    from lacuna.sources.profiles import write_profile

    if params.chunk_size is None:
        limited = Profile(
            pairs_in_view(profile, params.region), profile.hist, profile.read_groups, profile.contigs
        )
        write_profile(limited, params.out, mode="overwrite")
        return
    contig = _region(profile, params.region).first()["contig"] if params.region else None
    pairs = chunk_pairs(profile, "chunk", params.chunk_size, params.padding or 0, contig)
    (
        pairs.repartitionByRange("file", "win", "rg")
        .sortWithinPartitions("file", "win", "rg")
        .write.mode("overwrite")
        .partitionBy("file")
        .parquet(f"{params.out}/pairs")
    )
    for name in ("hist", "read_groups", "contigs"):
        getattr(profile, name).write.mode("overwrite").parquet(f"{params.out}/{name}")
