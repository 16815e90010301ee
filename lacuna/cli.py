"""Command line: ``python -m lacuna profile|call|view``."""

from __future__ import annotations

import argparse
import sys
from functools import partial

from pyspark.sql import SparkSession

from lacuna import __version__
from lacuna.params import CallParams, ParameterError, ProfileParams, ReadQuality, ViewParams
from lacuna.session import remove_run_folder

#: Warnings of one kind that are printed one by one; more are counted.
SHOWN_WARNINGS = 20


def warn(text: str) -> None:
    print(f"lacuna: warning: {text}", file=sys.stderr)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lacuna", description="Joint deletion calling on Spark")
    top.add_argument("--version", action="version", version=__version__)
    commands = top.add_subparsers(dest="command", required=True)

    p = commands.add_parser("profile", help="alignment records to profiles")
    p.add_argument("reads", help="alignment records: a Parquet path, a .bam file, or a .txt file that lists .bam files")
    p.add_argument("regions", nargs="*", help="CHROM:BEGIN-END")
    p.add_argument("--contigs", help="Parquet table (contig, contig_id, len); read from .bam headers otherwise")
    p.add_argument("-o", "--out", required=True)
    p.add_argument("-r", "--reference", default="GRCh38")
    p.add_argument("-d", "--max-deletion-size", type=int, default=10_000)
    p.add_argument("-i", "--intervals")
    p.add_argument("-mrg", "--merge-read-groups", action="store_true")
    p.add_argument("-n", "--min-read-num", type=int, default=50_000)
    p.add_argument("-f", "--flags-set", type=int, default=33)
    p.add_argument("-F", "--flags-unset", type=int, default=3868)
    p.add_argument("-mq", "--min-mapping-qual", type=int, default=1)
    p.add_argument("-s", "--min-align-score", type=float, default=0.8)
    p.add_argument("-u", "--min-unclipped", type=int, default=50)

    c = commands.add_parser("call", help="profiles to deletion calls")
    c.add_argument("profiles", nargs="+", help="profile datasets, or one file that lists them")
    c.add_argument("-o", "--out", default="calls.vcf")
    c.add_argument("--parts", action="store_true", help="leave header and records as folders below --out")
    c.add_argument("-A", "--active-coverage-file")
    c.add_argument("-a", "--active-coverage", type=int, default=100)
    c.add_argument("-d", "--max-deletion-size", type=int, default=10_000)
    c.add_argument("-e", "--per-sample-rgid", action="store_true")
    c.add_argument("-l", "--min-init-length", type=int)
    c.add_argument("-m", "--min-length", type=int)
    c.add_argument("-r", "--region-of-interest", action="append", default=[])
    c.add_argument("-R", "--ROI-file")
    c.add_argument("-s", "--min-sample-fraction", type=float, default=0.1)
    c.add_argument("-C", "--cell-population", action="store_true")
    c.add_argument("-b", "--buffer-size", type=int, default=200_000)
    c.add_argument("-c", "--min-relative-window-cover", type=float, default=0.5)
    c.add_argument("-f", "--pseudocount-fraction", type=int, default=500)
    c.add_argument("-F", "--output-failed", action="store_true")
    c.add_argument("-n", "--no-regenotyping", action="store_true")
    c.add_argument("-p", "--prior-probability", type=float, default=1e-4)
    c.add_argument("-t", "--iterations", type=int, default=15)
    c.add_argument("-u", "--unsmoothed", action="store_true")

    v = commands.add_parser("view", help="profiles as text or with another layout")
    v.add_argument("profile")
    v.add_argument("-e", "--header", action="store_true")
    v.add_argument("-E", "--onlyHeader", action="store_true")
    v.add_argument("-i", "--histograms", action="store_true")
    v.add_argument("-o", "--out")
    v.add_argument("-r", "--region")
    v.add_argument("-c", "--chunk-size", type=int)
    v.add_argument("-p", "--padding", type=int)
    v.add_argument("-s", "--sample", help="only this sample of the dataset")
    v.add_argument("-t", "--text", help="folder for the lines, in order, instead of standard output")
    return top


def profile_params(a: argparse.Namespace) -> ProfileParams:
    quality = ReadQuality(
        a.flags_set, a.flags_unset, True, a.min_mapping_qual, a.min_unclipped, a.min_align_score
    )
    return ProfileParams(
        reference=a.reference, max_deletion=a.max_deletion_size, merge_read_groups=a.merge_read_groups,
        min_pairs=a.min_read_num, quality=quality,
    )


def call_params(a: argparse.Namespace) -> CallParams:
    return CallParams(
        max_load=a.active_coverage, max_deletion=a.max_deletion_size, per_sample_rg=a.per_sample_rgid,
        min_init_len=a.min_init_length, min_len=a.min_length, min_sample_fraction=a.min_sample_fraction,
        cell_population=a.cell_population, segment_size=a.buffer_size,
        min_rel_window_cover=a.min_relative_window_cover, pseudocount_fraction=a.pseudocount_fraction,
        output_failed=a.output_failed, window_wise=a.no_regenotyping, prior=a.prior_probability,
        iterations=a.iterations, smoothing=not a.unsmoothed,
    )


def view_params(a: argparse.Namespace) -> ViewParams:
    return ViewParams(
        header=a.header, only_header=a.onlyHeader, histograms=a.histograms, out=a.out, region=a.region,
        chunk_size=a.chunk_size, padding=a.padding,
    )


def run_profile(spark: SparkSession, a: argparse.Namespace) -> None:
    from lacuna.plans.profile import build_profile, coverage_warnings, unknown_sampling_contigs
    from lacuna.sources import alignments, profiles

    groups = within = None
    if a.reads.endswith((".bam", ".txt")):
        paths = [a.reads] if a.reads.endswith(".bam") else profiles.profile_list(spark, a.reads)
        groups = alignments.bam_read_groups(spark, paths)
        records = alignments.read_bam(spark, paths)
        contigs = alignments.bam_contigs(spark, paths)
        within = partial(alignments.read_regions, spark, paths)
    else:
        records = spark.read.schema(profiles.READS).parquet(a.reads)
        if a.contigs is None:
            raise ParameterError("--contigs is needed for Parquet input")
        contigs = spark.read.schema(profiles.CONTIGS).parquet(a.contigs)
    rois = spark.createDataFrame([(r,) for r in a.regions], "value string") if a.regions else None
    sampling = profiles.words(spark, a.intervals) if a.intervals else None
    if sampling is not None:
        for r in unknown_sampling_contigs(sampling, contigs).limit(SHOWN_WARNINGS).collect():
            warn(f"no sampling on {r['contig']!r}: the reference has no such contig")
    profile = build_profile(records, contigs, profile_params(a), rois, sampling, groups, within)
    profiles.write_profile(profile, a.out)
    shallow = coverage_warnings(profile)
    total = shallow.count()
    for r in shallow.orderBy("sample", "rg").limit(SHOWN_WARNINGS).collect():
        warn(f"low coverage of read group {r['rg']!r} of sample {r['sample']!r}: {r['coverage']:.2f}")
    if total > SHOWN_WARNINGS:
        warn(f"low coverage of {total} read groups in all")


def run_call(spark: SparkSession, a: argparse.Namespace) -> None:
    from lacuna.plans.call import call_deletions, vcf_records
    from lacuna.sources import profiles, variants

    paths = a.profiles if len(a.profiles) > 1 else profiles.inputs(spark, a.profiles[0])
    profile = profiles.read_profiles(spark, paths)
    rois = None
    if a.region_of_interest:
        rois = spark.createDataFrame([(r,) for r in a.region_of_interest], "value string")
    if a.ROI_file:
        listed = profiles.words(spark, a.ROI_file)
        rois = listed if rois is None else rois.unionByName(listed)
    limits = profiles.load_limits(spark, a.active_coverage_file) if a.active_coverage_file else None
    result = call_deletions(profile, call_params(a), rois, limits)
    variants.write_vcf(vcf_records(result), profile.contigs, result.order, a.out, parts=a.parts)


def run_view(spark: SparkSession, a: argparse.Namespace) -> None:
    from lacuna.plans import view
    from lacuna.sources import profiles

    params = view_params(a)
    profile = profiles.read_profile(spark, a.profile)
    if a.sample is not None:
        profile = profiles.of_sample(profile, a.sample)
    elif a.out is None and len(profile.read_groups.select("sample").distinct().limit(2).collect()) > 1:
        raise ParameterError("the dataset holds several samples; choose one with --sample")
    if params.out is not None:
        view.write_chunks(profile, params)
        return
    head = view.header(profile) if params.header or params.only_header else []
    if params.histograms and not params.only_header:
        more, lines = view.histogram_text(profile)
        head, lines = head + more, lines.orderBy("size")
    else:
        lines = view.window_text(profile, params.region).join(profile.contigs.select("contig", "contig_id"), "contig")
        lines = lines.orderBy("contig_id", "win")
    if a.text is not None:
        spark.createDataFrame([(h,) for h in head], "line string").coalesce(1).write.text(f"{a.text}/header")
        if not params.only_header:
            lines.select("line").write.text(f"{a.text}/lines")
        return
    for h in head:
        print(h)
    if not params.only_header:
        for r in lines.toLocalIterator():
            print(r["line"])


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"lacuna {a.command}").getOrCreate()
    try:
        {"profile": run_profile, "call": run_call, "view": run_view}[a.command](spark, a)
    except ParameterError as e:
        print(f"lacuna: {e}", file=sys.stderr)
        return 1
    finally:
        remove_run_folder(spark)
    return 0
