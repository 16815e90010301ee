"""The shared test tables read as the engine's own relations.

``events`` plays the read pairs of ten read groups in five samples, ``lineitem`` the alignment
records of three read groups, ``orders`` a set of intervals.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lacuna.operators import em, genotyping, histograms, windows
from lacuna.operators.em_kernel import Settings
from lacuna.params import CallParams
from lacuna.session import materialise

N_SAMPLES = 5
READ_LEN = 50
#: Small thresholds, so that the shallow stand-in data yields candidates.
MIN_INIT_LEN = 20
MIN_LEN = 20


def big(expr: str):
    return F.expr(expr).cast("bigint")


class Pairs:
    """Relations derived from ``events``.

    With ``staged``, read-group statistics and sample windows are written once and read back, as
    they are between the commands; otherwise everything stays one lazy plan.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, max_load: int = 100, staged: bool = False) -> None:
        self.spark = spark
        self.sf_dir = sf_dir
        self.max_load = max_load
        self.staged = staged

    @classmethod
    def stage(cls, spark: SparkSession, sf_dir: str) -> Pairs:
        return cls(spark, sf_dir, staged=True)

    def _keep(self, df: DataFrame) -> DataFrame:
        return materialise(df) if self.staged else df

    @cached_property
    def pairs(self) -> DataFrame:
        minute = "datediff(to_date(ts), date'2024-01-01') * 1440 + hour(ts) * 60 + minute(ts)"
        return self.spark.read.parquet(f"{self.sf_dir}/events.parquet").select(
            F.col("event_type").alias("contig"),
            big("user_id % 5").alias("sample"),
            big("user_id % 10").alias("rg"),
            big(minute).alias("start"),
            big("200 + floor(value)").alias("isize"),
        )

    @cached_property
    def hist(self) -> DataFrame:
        return histograms.insert_size_histogram(self.pairs.select("rg", F.col("isize").alias("size")))

    @cached_property
    def medians(self) -> DataFrame:
        return histograms.lower_median(self.hist).withColumn("read_len", F.lit(READ_LEN).cast("bigint"))

    @cached_property
    def borders(self) -> DataFrame:
        """Full range of sizes with one irregular slot at either end."""
        return self.hist.groupBy("rg").agg(
            (F.min("size") - 1).alias("lo"), (F.max("size") + 2).alias("hi")
        )

    @cached_property
    def stats(self) -> DataFrame:
        if self.staged:
            return self.density.select("rg", "median", "read_len", "mean", "stddev")
        return self._stats

    @cached_property
    def _stats(self) -> DataFrame:
        return self.medians.join(histograms.moments(self.hist).select("rg", "mean", "stddev"), "rg")

    @cached_property
    def density(self) -> DataFrame:
        dense = histograms.dense_histogram(self.hist, self.borders).join(self._stats, "rg")
        return self._keep(histograms.densities(dense))

    @cached_property
    def spanned(self) -> DataFrame:
        return windows.with_span(self.pairs, self.stats if self.staged else self.medians)

    @cached_property
    def active(self) -> DataFrame:
        return windows.active_pairs(self.spanned)

    @cached_property
    def loaded(self) -> DataFrame:
        counts = windows.deviation_counts(self.active)
        return self._keep(windows.with_load(counts, None, self.max_load))

    @cached_property
    def thresholds(self) -> DataFrame:
        return histograms.initial_thresholds(self.stats.select("rg", "stddev"), MIN_INIT_LEN)

    @cached_property
    def windows(self) -> DataFrame:
        return windows.sample_windows(self.loaded, self.thresholds)

    @cached_property
    def candidates(self) -> DataFrame:
        return self._keep(windows.candidate_lengths(self.windows))

    @cached_property
    def obs(self) -> DataFrame:
        return windows.usable(self.loaded)

    @cached_property
    def hot(self) -> DataFrame:
        return self.loaded.where("high_cov").select("contig", "p", "rg").distinct()

    @cached_property
    def seeds(self) -> DataFrame:
        """Candidates with their starting frequency and genotype weights."""
        seeds = em.frequency_seed(self.obs, self.candidates, self.stats).where(F.col("af") > 0)
        return self._keep(em.with_prior(seeds).withColumn("len", F.col("len0")))

    @cached_property
    def densities(self) -> DataFrame:
        return em.pair_densities(self.obs, self.seeds, self.density)

    @cached_property
    def likelihoods(self) -> DataFrame:
        return em.scaled_likelihoods(em.log_likelihoods(self.densities, "sample"))

    def settings(self, params: CallParams) -> Settings:
        return Settings(
            n_samples=N_SAMPLES, min_len=MIN_LEN, min_lr=params.min_likelihood_ratio,
            iterations=params.iterations, cell_population=params.cell_population,
            strict=params.strict_parity,
        )

    def genotyped(self, params: CallParams, block_samples: int = genotyping.BLOCK_SAMPLES) -> DataFrame:
        ready = genotyping.candidate_observations(self.loaded, self.candidates)
        if block_samples < N_SAMPLES:
            ready = materialise(ready)
        return genotyping.genotype_windows(ready, self.density, self.settings(params), block_samples)


class Reads:
    """Relations derived from ``lineitem``."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir

    @cached_property
    def reads(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/lineitem.parquet").select(
            F.col("l_orderkey").alias("qname"),
            F.col("l_linestatus").alias("contig"),
            F.col("l_returnflag").alias("rg"),
            F.col("l_partkey").alias("pos"),
            F.col("l_suppkey").alias("suppkey"),
            F.col("l_extendedprice").alias("price"),
            F.col("l_linenumber").alias("line"),
            big("round(l_discount * 100)").alias("mapq"),
            big("floor(l_quantity)").alias("l_seq"),
            big("floor(l_extendedprice / 100)").alias("size"),
            # One bit pattern per line number: both orientations plus every excluded kind.
            F.expr(
                "element_at(array(33, 17, 97, 81, 1057, 289, 2081), l_linenumber)"
            ).cast("int").alias("flag"),
        )

    @cached_property
    def hist(self) -> DataFrame:
        return histograms.insert_size_histogram(self.reads.select("rg", "size"))

    def mate_side(self, line: int) -> DataFrame:
        """One record per name and contig among those with a line number, last one winning."""
        latest = Window.partitionBy("qname", "contig").orderBy(
            F.desc("pos"), F.desc("suppkey"), F.desc("price"), F.desc("mapq"), F.desc("l_seq"), F.desc("rg")
        )
        return (
            self.reads.where(F.col("line") == line)
            .withColumn("rn", F.row_number().over(latest))
            .where("rn = 1")
            .drop("rn")
        )


class Intervals:
    """Relations derived from ``orders``."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir

    @cached_property
    def intervals(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/orders.parquet").select(
            F.col("o_orderkey").alias("itv"),
            F.col("o_orderpriority").alias("contig"),
            big("datediff(to_date(o_orderdate), date'1992-01-01') * 100 + o_orderkey % 97").alias("beg"),
        ).withColumn("end", F.col("beg") + 1 + F.col("itv") % 13)

    @cached_property
    def contigs(self) -> DataFrame:
        return self.intervals.groupBy("contig").agg(F.max("end").alias("len"))
