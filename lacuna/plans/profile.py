"""The ``profile`` command: alignment records to profiles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.operators import histograms, intervals, reads
from lacuna.params import ParameterError, ProfileParams
from lacuna.session import materialise
from lacuna.sources.profiles import Profile


#: Between sample and read group while both are one key.
GROUP_SEPARATOR = "\x1f"


def with_merged_groups(rows: DataFrame, read_groups: DataFrame) -> DataFrame:
    """Replaces every read group by the first one of its sample."""
    first = materialise(read_groups.groupBy("sample").agg(F.min("rg").alias("_first")))
    return rows.join(first, "sample").withColumn("rg", F.col("_first")).drop("_first")


def numbered(sampling: DataFrame, contigs: DataFrame) -> DataFrame:
    """Sampling intervals merged, restricted to known contigs and numbered in contig order."""
    merged = intervals.merge_intervals(intervals.close_intervals(sampling, contigs))
    ordered = intervals.in_contig_order(merged, contigs).select("contig", "contig_id", "beg", "end")
    # The intervals are a handful per contig; numbering them is not data sized.
    number = F.row_number().over(Window.orderBy("contig_id", "beg")) - 1
    return ordered.withColumn("itv", number.cast("bigint"))


#: Sampling intervals of the first round of a scan that stops early; every round takes twice as many as the one before.
FIRST_ROUND = 1


def counted(sampled: DataFrame) -> DataFrame:
    """Pairs per read group, interval and size, with the first one's read length; stored."""
    return materialise(
        sampled.groupBy("rg", "itv", "size").agg(
            F.count(F.lit(1)).alias("cnt"),
            F.min_by("read_len", F.struct("pos", "qname")).alias("read_len"),
            F.min(F.struct("pos", "qname")).alias("first"),
        )
    )


def counted_until_enough(
    scan: Callable[[DataFrame, list[str] | None], DataFrame], read_groups: DataFrame, itvs: DataFrame, params: ProfileParams
) -> DataFrame:
    """``counted`` of the intervals in order, in rounds: the next ones are only read for samples that are still short.

    ``scan(intervals, samples)`` gives the records of these intervals, of these samples or (None) of all.
    """
    last = itvs.agg(F.max("itv")).first()[0]
    found, lo, size, short = None, 0, FIRST_ROUND, None
    while last is not None and lo <= last and (short is None or short):
        part = itvs.where((F.col("itv") >= lo) & (F.col("itv") < lo + size))
        more = counted(reads.sampled_sizes(scan(part, short), part, params))
        found = more if found is None else found.union(more)
        counts = found.groupBy("rg", "itv").agg(F.sum("cnt").alias("cnt"))
        stop = histograms.sampling_stop(counts, read_groups, params.min_pairs, "sample")
        short = [r["sample"] for r in stop.where(F.col("last_itv").isNull()).select("sample").collect()]
        lo, size = lo + size, size * 2
    return counted(reads.sampled_sizes(scan(itvs, None), itvs, params)) if found is None else found


def read_group_statistics(
    per_interval: DataFrame, read_groups: DataFrame, itvs: DataFrame, params: ProfileParams
) -> tuple[DataFrame, DataFrame]:
    """``(hist, statistics)`` from the shortest run of intervals that is enough for every group."""
    counts = per_interval.groupBy("rg", "itv").agg(F.sum("cnt").alias("cnt"))
    stop = histograms.sampling_stop(counts, read_groups, params.min_pairs, "sample")
    short = stop.where(F.col("last_itv").isNull()).select("sample").limit(20).collect()
    if short:
        names = ", ".join(repr(r["sample"]) for r in short)
        raise ParameterError(
            f"not enough read pairs in the sampling intervals for {names}; "
            "use other intervals or lower min_pairs"
        )
    owned = per_interval.join(read_groups.select("rg", "sample"), "rg").join(stop, "sample")
    used = owned.where(F.col("itv") <= F.col("last_itv"))
    hist = used.groupBy("rg", "size").agg(F.sum("cnt").alias("cnt"))
    read_len = used.groupBy("rg").agg(F.min_by("read_len", F.struct("itv", "first")).alias("read_len"))
    upto = F.sum(F.col("end") - F.col("beg") - 1).over(Window.orderBy("itv"))
    reached = itvs.select(F.col("itv").alias("last_itv"), upto.alias("sampled_length"))
    length = stop.join(reached, "last_itv").select("sample", "sampled_length")
    stats = (
        histograms.trimmed_stats(hist, params.max_size)
        .join(read_len, "rg")
        .join(hist.groupBy("rg").agg(F.sum("cnt").alias("n")), "rg")
        .join(read_groups.select("rg", "sample"), "rg")
        .join(length, "sample")
        .withColumn("coverage", histograms.depth(F.col("n"), F.col("sampled_length"), F.col("read_len")))
        .select("rg", "sample", "median", "mean", "stddev", "read_len", "lo", "hi", "coverage")
    )
    return hist, materialise(stats)


def _listed(intervals: DataFrame, before: int, behind: int) -> list[tuple[str, int, int]]:
    return [(r["contig"], max(0, r["beg"] - before), r["end"] + behind) for r in intervals.select("contig", "beg", "end").collect()]


def build_profile(
    records: DataFrame, contigs: DataFrame, params: ProfileParams,
    rois: DataFrame | None = None, sampling: DataFrame | None = None, groups: DataFrame | None = None,
    within: Callable[[list[tuple[str, int, int]], list[str] | None], DataFrame] | None = None,
) -> Profile:
    """Profile of all samples in ``records``.

    ``groups(rg, sample)`` are the read groups where a header names them; else a scan finds them.

    ``rois(value)`` limits the profile, ``sampling(value)`` replaces the default sampling intervals;
    both hold region texts. ``within(regions, samples)`` gives the records that overlap (contig, begin, end) regions, of these
    samples or of all, where the source can look them up: then only what is sampled and what the regions of interest can pair
    up is read, and sampling stops reading once a sample has enough. Regions are lists a user states, so they are
    gathered.
    """
    spark = records.sparkSession
    # Identifiers are unique within a sample only, so work is keyed by sample and identifier together.
    keyed = lambda df: df.withColumn("rg", F.concat("sample", F.lit(GROUP_SEPARATOR), "rg"))
    given = keyed
    records = keyed(records)
    groups = records.select("rg", "sample").distinct() if groups is None else keyed(groups.select("rg", "sample")).distinct()
    if params.merge_read_groups:
        every = groups
        given = lambda df: with_merged_groups(keyed(df), every)
        records = with_merged_groups(records, groups)
        groups = groups.groupBy("sample").agg(F.min("rg").alias("rg")).select("rg", "sample")
    groups = materialise(groups)
    regions = None
    if rois is not None:
        regions = materialise(intervals.regions_of_interest(rois, contigs, params.max_deletion))
    if sampling is not None:
        wanted = intervals.parse_regions(sampling)
    else:
        on = intervals.whole_contigs(contigs) if regions is None else regions
        wanted = intervals.default_sampling(spark, params.reference, on)
    itvs = materialise(numbered(wanted, contigs))
    if within is None:
        sampled = counted(reads.sampled_sizes(records, itvs, params))
    else:
        # a record at the interval's end position still counts
        sampled = counted_until_enough(lambda part, some: given(within(_listed(part, 0, 1), some)), groups, itvs, params)
    hist, stats = read_group_statistics(sampled, groups, itvs, params)
    if within is not None and regions is not None:
        # a pair of the region has its mates no farther from it than the longest template
        reach = reads.max_insert_sizes(stats, params.max_deletion).agg(F.max("max_insert")).first()[0] or 0
        records = given(within(_listed(regions, reach, reach), None))
    pairs = reads.read_pairs(records, stats, params, regions)
    kept = hist.join(stats.select("rg", "sample", "lo", "hi"), "rg").where(
        (F.col("size") >= F.col("lo")) & (F.col("size") < F.col("hi"))
    )
    own = F.expr(f"substring(rg, length(sample) + {len(GROUP_SEPARATOR) + 1})")
    return Profile(
        reads.to_profile(pairs, stats).withColumn("rg", own),
        kept.select("sample", own.alias("rg"), "size", "cnt"),
        stats.withColumn("rg", own),
        contigs,
    )


def unknown_sampling_contigs(sampling: DataFrame, contigs: DataFrame) -> DataFrame:
    """Contigs of sampling intervals that the reference lacks; these intervals are not sampled."""
    return intervals.unknown_contigs(intervals.parse_regions(sampling), contigs).select("contig").distinct()


def coverage_warnings(profile: Profile, minimum: float = 5.0) -> DataFrame:
    """Read groups too shallow for reliable calls."""
    return histograms.low_coverage(profile.read_groups, minimum).select("sample", "rg", "coverage")
