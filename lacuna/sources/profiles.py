"""Profiles as a Parquet dataset, and the text inputs of the commands.

A dataset holds one or many samples in four tables: ``pairs`` (deviations by 256-bp window, in folders by contig
and tile and sorted by window, so that regions prune folders and row groups), ``hist``, ``read_groups`` and
``contigs``.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.params import PROFILE_WINDOW, ParameterError

PAIRS = "contig string, win bigint, sample string, rg string, off bigint, dev bigint"
#: Width of a folder of ``pairs``; a genome has a few hundred.
TILE = 1 << 24
STORED_PAIRS = PAIRS + ", tile bigint"
HIST = "sample string, rg string, size bigint, cnt bigint"
READ_GROUPS = (
    "rg string, sample string, median bigint, mean double, stddev double, read_len bigint,"
    " lo bigint, hi bigint, coverage double"
)
CONTIGS = "contig string, contig_id bigint, len bigint"

#: Alignment records as the engine expects them; bases and qualities are never read.
READS = (
    "sample string, contig string, pos int, mapq int, flag int, l_seq int, mate_contig string, mate_pos int,"
    " tlen int, cigar array<struct<op:string,n:int>>, qname string, rg string, as_score int"
)


@dataclass(frozen=True)
class Profile:
    pairs: DataFrame
    hist: DataFrame
    read_groups: DataFrame
    contigs: DataFrame


def tile_of(win: Column) -> Column:
    return F.floor(win / F.lit(TILE)).cast("bigint")


def in_regions(regions: DataFrame) -> Column | None:
    """Test of ``contig``, ``tile`` and ``win`` for ``regions(contig, beg, end)``; None without a region.

    One literal test per contig and tile that a region meets, with the outermost windows asked for in that tile:
    it reaches the scan as folder and row-group filters, and its size is bounded by the genome, however many
    regions there are. A dataset without tiles is tested by window alone.
    """
    # A pair's window may start up to one window before the region.
    begin, end = F.greatest(F.col("beg") - PROFILE_WINDOW + 1, F.lit(0)), F.col("end") - 1
    met = regions.where(end >= begin).select(
        "contig", begin.alias("beg"), end.alias("end"), F.explode(F.sequence(tile_of(begin), tile_of(end))).alias("tile")
    )
    asked = met.groupBy("contig", "tile").agg(
        F.min(F.greatest(F.col("beg"), F.col("tile") * TILE)).alias("low"),
        F.max(F.least(F.col("end"), (F.col("tile") + 1) * TILE - 1)).alias("high"),
    )
    met_folders = asked.orderBy("contig", "tile").collect()
    if not met_folders:
        return None
    folders = [(F.col("contig") == a["contig"]) & (F.col("tile").isNull() | (F.col("tile") == a["tile"])) for a in met_folders]
    inside = [f & F.col("win").between(a["low"], a["high"]) for f, a in zip(folders, met_folders, strict=True)]
    # the test of folders stands alone too: where they are taken from file names, only such a test chooses files
    return _any(folders) & _any(inside)


def _any(tests: list[Column]) -> Column:
    """Disjunction as a balanced tree: its depth stays small with many tests."""
    if len(tests) == 1:
        return tests[0]
    half = len(tests) // 2
    return _any(tests[:half]) | _any(tests[half:])


def write_profile(profile: Profile, path: str, mode: str = "append") -> None:
    """Writes or appends a profile; a sample that is stored already is refused.

    Ranges over contig, window, sample and read group keep a deep contig from ending in one task.
    """
    if mode == "append":
        refuse_stored_samples(profile, path)
    checked = profile.pairs.withColumn(
        "off",
        F.when(F.col("off").between(0, PROFILE_WINDOW - 1), F.col("off")).otherwise(
            F.raise_error(F.lit("pair outside its window")).cast("bigint")
        ),
    )
    (
        checked.withColumn("tile", tile_of(F.col("win")))
        .repartitionByRange("contig", "win", "sample", "rg")
        .sortWithinPartitions("contig", "tile", "win", "sample", "rg", "off", "dev")
        .write.mode(mode)
        .partitionBy("contig", "tile")
        .parquet(f"{path}/pairs")
    )
    for name in ("hist", "read_groups", "contigs"):
        getattr(profile, name).write.mode(mode).parquet(f"{path}/{name}")


def read_profile(spark: SparkSession, path: str) -> Profile:
    """Opens a dataset. Contigs of appended samples are reduced to one representative set."""
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{path}/{name}")
    contigs = read("contigs", CONTIGS).groupBy("contig").agg(
        F.min("contig_id").alias("contig_id"), F.max("len").alias("len")
    )
    return Profile(read("pairs", STORED_PAIRS), read("hist", HIST), read("read_groups", READ_GROUPS), contigs)


def refuse_stored_samples(profile: Profile, path: str) -> None:
    """Raises if the dataset at ``path`` holds one of the samples."""
    spark = profile.read_groups.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/read_groups")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return
    stored = spark.read.schema(READ_GROUPS).parquet(f"{path}/read_groups").select("sample")
    twice = profile.read_groups.select("sample").join(stored, "sample", "left_semi").first()
    if twice is not None:
        raise ParameterError(f"sample {twice['sample']!r} is in this profile already")


def per_sample_read_groups(profile: Profile) -> Profile:
    """Renames every read group to ``sample:rg``; for samples that share identifiers."""
    named = lambda df: df.withColumn("rg", F.concat_ws(":", "sample", "rg"))
    return Profile(named(profile.pairs), named(profile.hist), named(profile.read_groups), profile.contigs)


def of_sample(profile: Profile, sample: str) -> Profile:
    """The profile of one sample of a dataset."""
    own = lambda df: df.where(F.col("sample") == sample)
    return Profile(own(profile.pairs), own(profile.hist), own(profile.read_groups), profile.contigs)


def duplicate_read_groups(read_groups: DataFrame) -> DataFrame:
    """Identifiers that occur more than once, in several samples or in one that was read twice."""
    return read_groups.groupBy("rg").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def check_read_groups(profile: Profile) -> None:
    clash = duplicate_read_groups(profile.read_groups).first()
    if clash is not None:
        raise ParameterError(
            f"read group {clash['rg']!r} occurs more than once; use per_sample_rg for samples that share identifiers"
        )


# ---------------------------------------------------------------- text inputs


def words(spark: SparkSession, path: str) -> DataFrame:
    """Whitespace separated words of a text file in ``value``."""
    return (
        spark.read.text(path)
        .select(F.explode(F.split(F.trim("value"), r"\s+")).alias("value"))
        .where(F.col("value") != "")
    )


def profile_list(spark: SparkSession, path: str) -> list[str]:
    """Distinct paths of a list file in the order of their first occurrence.

    The list names the inputs of one run, so it is small by nature.
    """
    return list(dict.fromkeys(r["value"] for r in words(spark, path).collect()))


def load_limits(spark: SparkSession, path: str) -> DataFrame:
    """``RG value`` lines to ``(rg, max_load)``; 0 means no limit."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value") != "").select(
        F.get(parts, F.lit(0)).alias("rg"), F.get(parts, F.lit(1)).cast("bigint").alias("value")
    )
    limit = F.when(F.col("value").isNull(), F.raise_error(F.lit("no maximum load for a read group")).cast("bigint"))
    return rows.select(
        "rg", limit.when(F.col("value") == 0, F.lit(2**31 - 1)).otherwise(F.col("value")).alias("max_load")
    )


def inputs(spark: SparkSession, path: str) -> list[str]:
    """A single argument is a profile dataset itself or a text file that lists datasets."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [path] if fs.isDirectory(fs_path) else profile_list(spark, path)


def read_profiles(spark: SparkSession, paths: list[str]) -> Profile:
    """Several datasets as one. All must have the same contigs in the same order."""
    first = read_profile(spark, paths[0])
    if len(paths) == 1:
        return first
    # Contigs are few; one aggregation over those of all datasets finds the ones that some dataset lacks.
    dataset = F.regexp_extract("_metadata.file_path", r"^(.*)/contigs/[^/]*$", 1)
    every = spark.read.schema(CONTIGS).parquet(*[f"{p}/contigs" for p in dict.fromkeys(paths)]).withColumn("dataset", dataset)
    counts = every.groupBy("contig", "contig_id", "len").agg(F.count_distinct("dataset").alias("n"))
    other = counts.where(F.col("n") < len(dict.fromkeys(paths))).orderBy("contig_id", "contig").first()
    if other is not None:
        raise ParameterError(f"the profiles have different contigs: not all have {other['contig']!r} of length {other['len']} in place {other['contig_id']}")
    times = Counter(paths)
    stored = _pair_files(spark, list(times))
    # such a scan takes a file once; a dataset that is named again is read again
    for k in range(1, max(times.values())):
        stored = stored.unionByName(_pair_files(spark, [p for p, n in times.items() if n > k]))
    return Profile(
        stored,
        spark.read.schema(HIST).parquet(*[f"{p}/hist" for p in paths]),
        spark.read.schema(READ_GROUPS).parquet(*[f"{p}/read_groups" for p in paths]),
        first.contigs,
    )


def _pair_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Pairs of different datasets in one scan over all folders.

    Contig and tile are taken from the folder names, so the scan does not grow into a union of one branch per
    dataset. Tests of them choose files before any is opened.
    """
    folder = lambda name: F.regexp_extract("_metadata.file_path", f"/{name}=([^/]*)/", 1)
    return (
        spark.read.schema(PAIRS.replace("contig string, ", ""))
        .option("recursiveFileLookup", True)
        .parquet(*[f"{p}/pairs" for p in paths])
        .withColumns({"contig": F.url_decode(folder("contig")), "tile": F.nullif(folder("tile"), F.lit("")).cast("bigint")})
        .select("contig", "win", "sample", "rg", "off", "dev", "tile")
    )
