"""The ``call`` command: profiles of many samples to deletion calls."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions.text import sample_format
from lacuna.operators import em, genotyping, histograms, intervals, merging, reads, render, windows
from lacuna.operators.em_kernel import Settings
from lacuna.params import CallParams
from lacuna.session import materialise
from lacuna.sources.profiles import Profile, check_read_groups, in_regions, per_sample_read_groups, tile_of


@dataclass(frozen=True)
class Calls:
    """Final calls, their genotypes per sample with data, and the column order of all samples."""

    calls: DataFrame
    samples: DataFrame
    order: DataFrame
    n_samples: int
    merged: bool


def cohort_density(profile: Profile, params: CallParams) -> DataFrame:
    """Density and statistics per read group, written once: everything later looks them up."""
    groups = profile.read_groups
    dense = histograms.dense_histogram(profile.hist, groups).join(
        groups.select("rg", "sample", "median", "stddev", "read_len"), "rg"
    )
    shaped = histograms.densities(
        dense, params.pseudocount_fraction, params.smoothing, params.strict_parity
    )
    return materialise(shaped)


def spanned_pairs(profile: Profile, groups: DataFrame, regions: DataFrame | None) -> DataFrame:
    """Read pairs with their sample and span, restricted to the regions of interest.

    Membership is tested on the 30-bp bin of the start.
    """
    stored = profile.pairs
    bounds = None if regions is None else in_regions(regions)
    if bounds is not None:
        tiled = stored if "tile" in stored.columns else stored.withColumn("tile", tile_of(F.col("win")))
        stored = tiled.where(bounds)
    pairs = reads.from_profile(stored, groups)
    if regions is not None:
        binned = pairs.withColumn("bin30", windows.grid_bin(F.col("start")))
        pairs = intervals.windows_in_regions(binned, "bin30", regions.select("contig", "beg", "end")).drop("bin30")
    return windows.with_span(pairs, groups)


def call_deletions(
    profile: Profile, params: CallParams, rois: DataFrame | None = None, max_load: DataFrame | None = None
) -> Calls:
    """Joint calling over all samples of ``profile``.

    ``rois(value)`` holds region texts, ``max_load(rg, max_load)`` limits per read group.
    """
    if params.per_sample_rg:
        profile = per_sample_read_groups(profile)
    check_read_groups(profile)
    density = cohort_density(profile, params)
    # Everything per read group except the arrays, which are handled where they are needed.
    groups = density.drop("values")
    thresholds = histograms.initial_thresholds(groups.select("rg", "stddev"), params.min_init_len)
    scalars = histograms.cohort_scalars(thresholds).first()
    order = genotyping.sample_order(groups)
    n_samples = order.count()
    settings = Settings(
        n_samples=n_samples,
        min_len=params.min_len if params.min_len is not None else scalars["min_len"],
        min_lr=params.min_likelihood_ratio,
        iterations=params.iterations,
        cell_population=params.cell_population,
        strict=params.strict_parity,
    )
    regions = None
    if rois is not None:
        regions = materialise(intervals.regions_of_interest(rois, profile.contigs))
    spanned = materialise(spanned_pairs(profile, groups, regions))
    if params.strict_parity:
        from lacuna.streaming.admission import admitted_pairs

        spanned = admitted_pairs(spanned, max_load, params.load_limit)

    counts = windows.deviation_counts(windows.pruned_active(spanned, thresholds))
    loaded = materialise(windows.with_load(counts, max_load, params.load_limit))
    candidates = windows.candidate_lengths(windows.sample_windows(loaded, thresholds))
    observed = materialise(genotyping.candidate_observations(loaded, candidates))
    genotyped = materialise(genotyping.genotype_windows(observed, density, settings))

    hot = observed.where("high_cov").select("contig", "p", "rg").distinct()
    positions = genotyping.supported(genotyped, spanned, hot, groups)
    calls = genotyping.window_calls(
        genotyped, positions, n_samples, params.min_sample_fraction, params.window_wise
    )
    if params.window_wise:
        kept = calls.where((F.col("iterations") != 0) & (F.lit(params.output_failed) | (F.col("filter") == 0)))
        return Calls(materialise(kept.withColumn("sig_windows", F.lit(0).cast("bigint"))), genotyped, order, n_samples, False)
    segmented = genotyping.with_segments(calls, genotyping.first_grid_points(spanned), params.segment_size)
    final, samples = merging.merge_calls(
        segmented, genotyped, float(scalars["mean_stddev"]), n_samples,
        params.min_rel_window_cover, params.output_failed,
    )
    return Calls(final, samples, order, n_samples, True)


def vcf_records(result: Calls) -> DataFrame:
    """``(contig, pos, len, line)`` of all calls."""
    if result.merged:
        return render.merged_vcf_lines(result.calls, result.samples, result.order, result.n_samples)
    zero = F.lit(0)
    absent = sample_format([zero] * 3, [zero] * 3, [zero] * 5, zero, zero)
    kept = result.samples.join(result.calls.select(*em.KEY), em.KEY, "left_semi")
    info = result.calls.select(*em.KEY, "pos", "len", "lr", "af", "sig_windows", "filter")
    return render.vcf_lines(
        info, render.call_cells(kept, em.KEY), result.order, result.n_samples, em.KEY, absent, False
    )
