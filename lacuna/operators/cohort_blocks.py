"""The estimation over blocks of samples, for cohorts whose densities do not fit one task.

Observations are dealt by grid part and block of samples. A round is two passes: every block sums what its
samples say about the length of a candidate, then what they say about its frequency; the sums of all blocks,
added in the order of the blocks, give the next state. A task holds the densities of one block and some
candidates' observations of that block, so its memory does not depend on the size of the cohort.

A saturated read group says as much as an absent one, so only the last pass, which reports the samples, reads it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lacuna.functions import genotype as G
from lacuna.operators import em, em_kernel
from lacuna.operators.em_kernel import Settings, Solution
from lacuna.session import materialise

WEIGHTS = ["g0", "g1", "g2"]
LONG, DOUBLE = T.LongType(), T.DoubleType()
STATE = T.StructType(
    [
        T.StructField(name, kind)
        for name, kind in (
            ("contig", T.StringType()), ("p", LONG), ("len0", LONG), ("block", T.IntegerType()), ("rounds", LONG),
            ("len", LONG), ("af", DOUBLE), ("g0", DOUBLE), ("g1", DOUBLE), ("g2", DOUBLE), ("shift", T.ArrayType(LONG)),
            ("old_len", LONG), ("old_af", DOUBLE), ("old_g0", DOUBLE), ("old_g1", DOUBLE), ("old_g2", DOUBLE),
            ("old_shift", T.ArrayType(LONG)),
            ("visited", T.ArrayType(T.StructType([T.StructField("len", LONG), T.StructField("af", DOUBLE)]))),
        )
    ]
)
#: What a pass adds: two sums over the block's samples, their number, the next shift per read group.
SUMS = [
    T.StructField("x", DOUBLE), T.StructField("y", DOUBLE), T.StructField("present", LONG), T.StructField("moved", T.ArrayType(LONG)),
]


def block_of(sample: Column | str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(sample), F.lit(blocks)).cast("int")


def genotype_in_blocks(observed: DataFrame, stats: DataFrame, schema: T.StructType, s: Settings, block_samples: int) -> DataFrame:
    """Rows as of one pass over whole candidates. ``stats(rg, stats, stddev)`` are the densities."""
    blocks = -(-s.n_samples // block_samples)
    observed = observed.withColumn("block", block_of("sample", blocks))
    usable = observed.where(~F.col("high_cov"))
    dealt_stats = materialise(observed.select("rg", "block").distinct().join(stats, "rg").select("rg", "block", "stats"))
    parts = max(1, int(observed.sparkSession.conf.get("spark.sql.shuffle.partitions")) // blocks)

    def sums(state: DataFrame, mode: str) -> DataFrame:
        found = _pass(usable, state, dealt_stats, T.StructType(STATE.fields + SUMS), parts, blocks, mode, s)
        # a stated order of addition: the last bits do not depend on where a block ran
        whole = Window.partitionBy(*em.KEY).orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return found.withColumns({c: F.sum(c).over(whole) for c in ("x", "y", "present")})

    alive = materialise(_seeds(observed, stats, s))
    done, settled = [], []
    for _ in range(s.iterations):
        moved = materialise(_next_length(sums(alive.where(F.col("len") >= s.min_len), "length")))
        after = materialise(_next_frequency(sums(moved, "frequency"), s))
        done.append(alive.where(F.col("len") < s.min_len))
        settled.append(after.where("settled").drop("settled"))
        alive = after.where("NOT settled").drop("settled")
        if alive.isEmpty():
            break
    if settled:
        every = settled[0]
        for more in settled[1:]:
            every = every.unionByName(more)
        done.append(_better(sums(every, "ratio"), s))
    state = alive
    for more in done:
        state = state.unionByName(more)
    state = materialise(state.where((F.col("af") >= G.PSEUDO) & (F.col("len") >= s.min_len)))

    parts_schema = T.StructType([*schema.fields, T.StructField("block", T.IntegerType()), T.StructField("present", T.LongType())])
    rows = materialise(_pass(observed, state, dealt_stats, parts_schema, parts, blocks, "report", s))
    return _with_totals(rows, state, s).select(*schema.names)


def _seeds(observed: DataFrame, stats: DataFrame, s: Settings) -> DataFrame:
    """Starting state of every candidate once per block with one of its samples."""
    size, spread = F.col("len0"), 2 * F.col("stddev")
    low = F.greatest(F.floor(size / 2), F.floor(size - spread + 0.5))
    inside = (F.col("dev") > low) & (F.col("dev") < F.floor(size + spread))
    usable = ~F.col("high_cov")
    counted = observed.join(stats.select("rg", "stddev"), "rg").groupBy(*em.KEY, "block").agg(
        F.sum(F.when(usable & inside, F.col("cnt")).otherwise(0)).alias("inside"),
        F.sum(F.when(usable, F.col("cnt")).otherwise(0)).alias("total"),
    )
    whole = Window.partitionBy(*em.KEY)
    af = F.sum("inside").over(whole) / F.nullif(F.sum("total").over(whole), F.lit(0))
    seeded = counted.withColumn("af", af.cast("double")).where("af > 0")
    seeded = em.with_prior(seeded, s.cell_population).withColumns({"len": F.col("len0"), "rounds": F.lit(0).cast("bigint")})
    return seeded.select(
        *[F.col(f.name) if f.name in seeded.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in STATE if f.name != "visited"],
        F.array().cast(STATE["visited"].dataType).alias("visited"),
    )


def _next_length(found: DataFrame) -> DataFrame:
    """State with the length and the shifts that the deviations point at; the former ones are kept as old."""
    mean = F.when(F.col("x") > 0, F.greatest(F.col("y") / F.col("x"), F.lit(0.0))).otherwise(F.lit(0.0))
    here = F.struct("len", "af")
    return found.select(
        *em.KEY, "block", (F.col("rounds") + 1).alias("rounds"), F.floor(mean + 0.5).cast("bigint").alias("len"), "af", *WEIGHTS,
        F.col("moved").alias("shift"), F.col("len").alias("old_len"), F.col("af").alias("old_af"),
        *[F.col(c).alias(f"old_{c}") for c in WEIGHTS], F.col("shift").alias("old_shift"),
        F.concat("visited", F.array(here)).alias("visited"),
    )


def _next_frequency(found: DataFrame, s: Settings) -> DataFrame:
    """State with the next frequency and weights; candidates without any carrier left drop out."""
    q0, q1, q2 = F.col("g0"), F.lit(G.PSEUDO) * F.col("g1"), F.lit(G.PSEUDO) * F.col("g2")
    absent = (F.lit(s.n_samples) - F.col("present")) * (q1 + 2 * q2) / (q0 + q1 + q2)
    met = F.try_element_at(F.filter("visited", lambda v: v["len"] == F.col("len")), F.lit(-1))["af"]
    counted = found.withColumn("af", (F.col("x") + absent) / 2.0 / F.lit(s.n_samples)).where("af <> 0")
    weights = G.prior(F.col("af"), s.cell_population)
    return counted.select(
        *[weights[WEIGHTS.index(c)].alias(c) if c in WEIGHTS else F.col(c) for c in STATE.names],
        F.coalesce(F.abs(met - F.col("af")) <= em_kernel.SAME_FREQUENCY, F.lit(False)).alias("settled"),
    )


def _blank_ratio(weights: list[str], n_absent: Column) -> Column:
    g0, g1, g2 = (F.col(c) for c in weights)
    low = F.lit(G.PSEUDO)
    return n_absent * F.log((g0 + (g1 + g2) * low * low) / (g0 + (g1 + g2) * low))


def _better(found: DataFrame, s: Settings) -> DataFrame:
    """Of the last two estimates the one with the better ratio; weights are not restored."""
    n_absent = F.lit(s.n_samples) - F.col("present")
    old = F.col("x") + _blank_ratio([f"old_{c}" for c in WEIGHTS], n_absent)
    back = old > F.col("y") + _blank_ratio(WEIGHTS, n_absent)
    return found.select(
        *[F.when(back, F.col(f"old_{c}")).otherwise(F.col(c)).alias(c) if c in ("len", "af", "shift") else F.col(c) for c in STATE.names]
    )


def _with_totals(rows: DataFrame, state: DataFrame, s: Settings) -> DataFrame:
    """Ratio, number of samples with data and first sample of whole candidates in place of those of a block."""
    blocks = F.array_sort(F.collect_list(F.struct("block", "lr")))
    totals = rows.where("lead").groupBy(*em.KEY).agg(
        F.aggregate(blocks, F.lit(0.0), lambda total, b: total + b["lr"]).alias("ratio"),
        F.sum("present").alias("present"), F.sum("data_samples").alias("with_data"), F.min("sample").alias("first_sample"),
    )
    weights = state.groupBy(*em.KEY).agg(*[F.first(c).alias(c) for c in WEIGHTS])
    whole = totals.join(weights, em.KEY).withColumn(
        "ratio", F.col("ratio") + _blank_ratio(WEIGHTS, F.lit(s.n_samples) - F.col("present"))
    )
    kept = whole.where(F.col("ratio") >= s.min_lr).select(*em.KEY, "ratio", "with_data", "first_sample")
    return rows.drop("lr", "data_samples", "lead").join(kept, em.KEY).withColumns(
        {"lr": F.col("ratio"), "data_samples": F.col("with_data"), "lead": F.col("sample") == F.col("first_sample")}
    )


# ---------------------------------------------------------------- one pass


def _pass(
    observed: DataFrame, state: DataFrame, stats: DataFrame, schema: T.StructType, parts: int, blocks: int, mode: str, s: Settings
) -> DataFrame:
    """One pass of ``mode`` over the candidates of ``state``.

    Densities, states and observations of a cell meet in one sorted stream: densities first, then each candidate's
    state before its observations.
    """
    part = F.pmod(F.xxhash64("contig", "p"), F.lit(parts)).cast("int")
    asked = observed.join(state.select(*em.KEY).distinct(), em.KEY, "left_semi").withColumn("part", part)
    spread = stats.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    rows = asked.unionByName(state.withColumn("part", part), allowMissingColumns=True).unionByName(spread, allowMissingColumns=True)
    rows = rows.withColumn("cell", F.col("part") * blocks + F.col("block")).drop("part")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lacuna.operators.genotyping import densities_first

        resolve, rest = densities_first(batches)
        for table in em_kernel.whole_candidates(rest):
            columns = _solve(table, resolve, mode, s)
            if columns is not None:
                yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in arrow], schema=arrow)

    return (
        rows.repartitionById(parts * blocks, "cell")
        .sortWithinPartitions(F.col("stats").isNull(), "contig", "p", "len0", F.col("sample").isNotNull(), "sample", "rg", "dev")
        .mapInArrow(run, schema)
    )


def _solve(table: pa.Table, resolve, mode: str, s: Settings) -> dict[str, pa.Array] | None:
    is_state = table["len"].is_valid().to_numpy()
    if not is_state.any():
        return None
    cand = np.cumsum(is_state) - 1
    state = table.filter(pa.array(is_state)).combine_chunks()
    got = em_kernel.gather_as(table.filter(pa.array(~is_state)), cand[~is_state], len(state), resolve)
    b, rgs = got.block, got.rgs

    def at(prefix: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lists = state[f"{prefix}shift"].combine_chunks()
        shift = np.zeros(len(b.g_s), np.int64)
        shift[lists.is_valid().to_numpy(zero_copy_only=False)[b.g_c]] = lists.flatten().to_numpy()
        weights = np.stack([state[prefix + c].to_numpy() for c in WEIGHTS], axis=1)
        return state[f"{prefix}len"].to_numpy(), shift, weights

    def likelihoods(length: np.ndarray, shift: np.ndarray):
        ref, dl = em_kernel.pair_densities(b, rgs, length, shift)
        groups, samples = em_kernel.log_likelihoods(b, ref, dl)
        return ref, dl, em_kernel.scaled(groups), em_kernel.fallback(em_kernel.scaled(samples))

    length, shift, weights = at()
    present = np.bincount(b.s_c, minlength=b.n_c)
    x, y, moved = np.zeros(b.n_c), np.zeros(b.n_c), None
    if mode == "report":
        return _report(state, got, Solution(length, shift, state["af"].to_numpy(), weights, state["rounds"].to_numpy()), present, s)
    ref, dl, groups, d = likelihoods(length, shift)
    if mode == "length":
        x, y, shifts = em_kernel.length_sums(b, rgs, ref, dl, d, groups, weights)
        ends = np.concatenate([[0], np.cumsum(np.bincount(b.g_c, minlength=b.n_c))])
        moved = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(shifts))
    elif mode == "frequency":
        x = em_kernel.allele_sums(b, d, weights)
    else:
        old_length, old_shift, old_weights = at("old_")
        x = em_kernel.ratio_sums(b, likelihoods(old_length, old_shift)[3], old_weights)
        y = em_kernel.ratio_sums(b, d, weights)
    kept = {name: state[name].combine_chunks() for name in STATE.names}
    return kept | {
        "x": pa.array(x), "y": pa.array(y), "present": pa.array(present),
        "moved": pa.nulls(b.n_c, pa.list_(pa.int64())) if moved is None else moved,
    }


def _report(state: pa.Table, got: em_kernel.Gathered, sol: Solution, present: np.ndarray, s: Settings) -> dict[str, pa.Array]:
    b = got.block
    found = em_kernel.final(b, got.rgs, sol, s, em_kernel.ratio_sums)
    scalars = {
        "iterations": sol.rounds, "len": sol.length, "lr": found["lr"], "af": sol.af, "block": state["block"].to_numpy(), "present": present,
    }
    return got.rows(b, np.ones(len(b.s_c), bool), np.ones(len(b.s_c), bool), found, scalars)
