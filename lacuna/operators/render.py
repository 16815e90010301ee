"""Profiles, histograms and calls as lines of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions import genotype as G
from lacuna.functions import text as T
from lacuna.operators.genotyping import COUNTS
from lacuna.operators.merging import CALL


def profile_lines(profile: DataFrame, read_groups: list) -> DataFrame:
    """One line per profile window: contig, 1-based start, one cell of pairs per read group.

    A profile belongs to one sample, so the list of read groups is short.
    """
    pairs = F.array_sort(F.collect_list(F.struct("off", "dev")))
    cells = profile.groupBy("contig", "win", "rg").agg(T.window_pairs(pairs).alias("cell"))
    columns = [
        F.coalesce(F.max(F.when(F.col("rg") == F.lit(g), F.col("cell"))), F.lit(".")).alias(f"c{i}")
        for i, g in enumerate(read_groups)
    ]
    lines = cells.groupBy("contig", "win").agg(*columns)
    return lines.select(
        "contig", "win",
        F.concat_ws(
            "\t", "contig", (F.col("win") + 1).cast("string"), *[f"c{i}" for i in range(len(read_groups))]
        ).alias("line"),
    )


def header_lines(read_groups: list[str], contigs: list[tuple[str, int]]) -> list[str]:
    return [
        "@HD\tVN:0.1",
        *[f"@RG\tID:{g}" for g in read_groups],
        *[f"@SQ\tSN:{name}\tLN:{length}" for name, length in contigs],
    ]


def histogram_lines(hist: DataFrame, borders: DataFrame, read_groups: list) -> DataFrame:
    """One line per insert size with a count per read group, NA outside a group's range."""
    spine = borders.select(
        "rg", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)).alias("size")
    )
    counts = spine.join(hist, ["rg", "size"], "left").select(
        "rg", "size", F.coalesce("cnt", F.lit(0)).cast("string").alias("cnt")
    )
    columns = [
        F.coalesce(F.max(F.when(F.col("rg") == F.lit(g), F.col("cnt"))), F.lit("NA")).alias(f"c{i}")
        for i, g in enumerate(read_groups)
    ]
    rows = counts.groupBy("size").agg(*columns)
    # Sizes between the ranges of all groups still get a line.
    span = borders.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select(
        F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)).alias("size")
    )
    full = span.join(rows, "size", "left")
    cells = [F.coalesce(f"c{i}", F.lit("NA")) for i in range(len(read_groups))]
    return full.select("size", F.concat_ws("\t", F.col("size").cast("string"), *cells).alias("line"))


def histogram_header(rows: list, read_groups: list) -> list[str]:
    """Five header lines from collected ``(rg, median, stddev, read_len)`` rows of one sample."""
    by_rg = {r["rg"]: r for r in rows}
    cells = lambda name, show: "\t".join([name, *[show(by_rg[g]) for g in read_groups]])
    return [
        cells("#RG", lambda r: str(r["rg"])),
        cells("#Median", lambda r: str(r["median"])),
        cells("#Std_dev", lambda r: f"{r['stddev']:.6g}"),
        cells("#Read_length", lambda r: str(r["read_len"])),
        cells("INSERT_SIZE", lambda r: str(r["rg"])),
    ]


def default_cell() -> Column:
    """Cell of a sample without any data in the windows of a merged call.

    Breaking the tie of three zeros raises the last score, so the sample counts as covered but its
    genotype stays open.
    """
    zero, one = F.lit(0), F.lit(1)
    return T.sample_format([zero, zero, one], [zero] * 3, [zero] * 5, zero, zero)


def call_cells(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Format cell per call and sample with data."""
    c = F.col
    return samples.select(
        *keys, "sample",
        T.sample_format(
            [c("pl0"), c("pl1"), c("pl2")], [c(x) for x in COUNTS[:3]], [c(x) for x in COUNTS[3:]],
            F.coalesce("first", F.lit(0)), F.coalesce("last", F.lit(0)),
        ).alias("cell"),
        G.has_data(c("pl0"), c("pl1"), c("pl2")).alias("has_data"),
    )


def vcf_lines(
    calls: DataFrame, cells: DataFrame, order: DataFrame, n_samples: int, keys: list[str], absent: Column,
    absent_has_data: bool,
) -> DataFrame:
    """One line per call with a cell for every sample, in column order.

    The line holds one cell per sample by definition of the format. Cells arrive one row per
    sample; the gaps between present columns are filled row-locally instead of by a cross product.
    """
    placed = cells.join(order, "sample")
    before = F.coalesce(
        F.lag("column").over(Window.partitionBy(*keys).orderBy("column")), F.lit(-1).cast("bigint")
    )
    gap = (F.col("column") - F.col("_before") - 1).cast("int")
    padded = F.concat_ws("\t", F.array_append(F.array_repeat(absent, gap), F.col("cell")))
    rows = (
        placed.withColumn("_before", before)
        .withColumn("_text", padded)
        .groupBy(*keys)
        .agg(
            F.array_sort(F.collect_list(F.struct("column", "_text"))).alias("_cells"),
            F.max("column").alias("_last"),
            F.count(F.lit(1)).alias("_present"),
            F.count_if("has_data").alias("_covered"),
        )
    )
    absent_count = F.lit(n_samples) - F.col("_present")
    covered = F.col("_covered") + (absent_count if absent_has_data else F.lit(0))
    joined = calls.join(rows, keys)
    tail = F.array_repeat(absent, (F.lit(n_samples - 1) - F.col("_last")).cast("int"))
    body = F.concat_ws("\t", F.concat(F.transform("_cells", lambda e: e["_text"]), tail))
    c = F.col
    return joined.select(
        "contig", "pos", "len",
        F.concat_ws(
            "\t",
            "contig",
            T.vcf_position(c("pos")).cast("string"),
            F.lit("."), F.lit("N"), F.lit("<DEL>"),
            G.call_quality(c("lr")).cast("string"),
            G.filter_string(c("filter")),
            T.info_field(c("pos"), c("len"), c("af"), c("lr"), covered / F.lit(float(n_samples)), c("sig_windows")),
            F.lit(T.FORMAT_KEYS),
            body,
        ).alias("line"),
    )


def merged_vcf_lines(calls: DataFrame, samples: DataFrame, order: DataFrame, n_samples: int) -> DataFrame:
    """Lines of merged calls."""
    kept = samples.join(calls.select(*CALL), CALL, "left_semi")
    info = calls.select(*CALL, "pos", "len", "lr", "af", "sig_windows", "filter")
    return vcf_lines(info, call_cells(kept, CALL), order, n_samples, CALL, default_cell(), True)
