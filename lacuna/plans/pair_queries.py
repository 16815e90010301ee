"""Queries over read pairs: grid, candidates, one estimation step, genotypes, output."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from lacuna.functions import genotype as G
from lacuna.functions.density import lookup
from lacuna.operators import em, genotyping, histograms, intervals, merging, windows
from lacuna.params import CHI2_Q99, CallParams
from lacuna.plans.oracle import COUNTS, LENGTH_STEP, SHIFT_STEP, estimated_calls, unrolled_estimation
from lacuna.plans.registry import query
from lacuna.plans.stand_ins import MIN_LEN, N_SAMPLES, Pairs
from lacuna.streaming import admission

KEY = em.KEY


def r(column: str, digits: int = 6):
    return F.round(F.col(column), digits).alias(column)


# ---------------------------------------------------------------- grid


@query(
    "active_pairs",
    "SELECT contig, p, sample, rg, start, dev, end_pos FROM active",
    "active",
)
def active_pairs(spark, sf):
    return Pairs(spark, sf).active.select("contig", "p", "sample", "rg", "start", "dev", "end_pos")


@query(
    "active_coverage",
    """SELECT contig, p, sample, count(*) AS n_active, count(*) >= 2 AS has_data
FROM active GROUP BY contig, p, sample""",
    "active",
)
def active_coverage(spark, sf):
    return windows.active_coverage(Pairs(spark, sf).active).withColumn("has_data", F.col("n_active") >= 2)


@query(
    "high_cov_exclusion",
    """SELECT contig, p, sample, rg, CAST(n AS BIGINT) AS n, n >= 3 AS high_cov,
       CASE WHEN n < 3 THEN n_dev ELSE 0 END AS n_dev FROM (
  SELECT contig, p, sample, rg, count(*) AS n, count(DISTINCT dev) AS n_dev FROM active GROUP BY contig, p, sample, rg)""",
    "active",
)
def high_cov_exclusion(spark, sf):
    loaded = Pairs(spark, sf, max_load=3).loaded
    return loaded.groupBy("contig", "p", "sample", "rg", "n", "high_cov").agg(
        F.count_if(~F.col("high_cov")).alias("n_dev")
    )


@query(
    "sample_fraction_filter",
    """SELECT contig, p, count(*) FILTER (WHERE n_active >= 2) AS data_samples FROM sampled
GROUP BY contig, p HAVING count(*) FILTER (WHERE n_active >= 2) / 5.0::DOUBLE >= 0.6::DOUBLE""",
    "sampled",
)
def sample_fraction_filter(spark, sf):
    covered = windows.active_coverage(Pairs(spark, sf).active)
    return (
        covered.groupBy("contig", "p")
        .agg(F.count_if(F.col("n_active") >= 2).alias("data_samples"))
        .where(F.col("data_samples") / F.lit(N_SAMPLES) >= 0.6)
    )


@query(
    "first_last_active",
    """SELECT contig, p, sample, min(start) AS first_pos, max(end_pos) AS last_pos
FROM active GROUP BY contig, p, sample""",
    "active",
)
def first_last_active(spark, sf):
    return windows.first_last(Pairs(spark, sf).active)


@query(
    "support_percentiles",
    """SELECT contig, p, len0, list_sort(list(start))[CAST(floor((count(*) - 1) * 0.8::DOUBLE + 0.5) AS BIGINT) + 1] AS pos,
       list_sort(list(end_pos))[CAST(floor((count(*) - 1) * (1 - 0.8::DOUBLE) + 0.5) AS BIGINT) + 1] AS end_pos
FROM (SELECT c.contig, c.p, c.len0, u.start, u.end_pos FROM usable u
      JOIN cand c ON u.contig = c.contig AND u.p = c.p JOIN quant q ON q.rg = u.rg
      WHERE u.dev BETWEEN c.len0 - q.lower_q AND c.len0 + q.upper_q)
GROUP BY contig, p, len0""",
    "usable", "cand", "quant",
)
def support_percentiles(spark, sf):
    b = Pairs.stage(spark, sf)
    lead = b.candidates.withColumn("lead", F.lit(True)).withColumn("len", F.col("len0"))
    return genotyping.supported(lead, b.spanned, b.hot, b.density)


@query(
    "upper_half_median",
    "SELECT contig, p, sample, q3 FROM q3",
    "q3",
)
def upper_half_median(spark, sf):
    return Pairs(spark, sf).windows.where(F.col("q3").isNotNull()).select("contig", "p", "sample", "q3")


@query("candidate_lengths", "SELECT contig, p, len0 FROM cand", "cand")
def candidate_lengths(spark, sf):
    return Pairs(spark, sf).candidates


@query(
    "outlier_windows",
    """SELECT DISTINCT a.contig, a.p FROM active a WHERE a.dev > 150""",
    "active",
)
def outlier_windows(spark, sf):
    b = Pairs(spark, sf)
    thresholds = histograms.initial_thresholds(b.stats.select("rg", "stddev"), 150)
    return windows.outlier_windows(b.spanned, thresholds)


@query(
    "pruned_active",
    """SELECT contig, p, sample, rg, count(*) AS n FROM active
WHERE (contig, p // 480) IN (SELECT contig, p // 480 FROM active WHERE dev > 150) GROUP BY contig, p, sample, rg""",
    "active",
)
def pruned_active(spark, sf):
    b = Pairs(spark, sf)
    thresholds = histograms.initial_thresholds(b.stats.select("rg", "stddev"), 150)
    active = windows.pruned_active(b.spanned, thresholds)
    return active.groupBy("contig", "p", "sample", "rg").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- one estimation step


@query("af_seed", "SELECT contig, p, len0, round(af, 6) AS af FROM seed", "seed")
def af_seed(spark, sf):
    b = Pairs.stage(spark, sf)
    return em.frequency_seed(b.obs, b.candidates, b.stats).select(*KEY, r("af"))


@query(
    "density_lookup",
    """SELECT p.contig, p.rg, p.start, p.dev, round(coalesce(d.v, m.min_prob), 8) AS density
FROM pairs p JOIN med ON med.rg = p.rg JOIN minp m ON m.rg = p.rg
LEFT JOIN dens d ON d.rg = p.rg AND d.size = p.dev + med.median""",
    "pairs", "med", "minp", "dens",
)
def density_lookup(spark, sf):
    b = Pairs.stage(spark, sf)
    place = [F.col(c) for c in ("values", "min_prob", "offset", "median", "dev")]
    return b.spanned.join(b.density.drop("read_len"), "rg").select(
        "contig", "rg", "start", "dev", F.round(lookup(*place), 8).alias("density")
    )


@query(
    "data_loglik",
    """SELECT contig, p, len0, sample, round(l0, 4) AS l0, round(l1, 4) AS l1, round(l2, 4) AS l2,
       round(d0, 6) AS d0, round(d1, 6) AS d1, round(d2, 6) AS d2 FROM lik""",
    "lik",
)
def data_loglik(spark, sf):
    return Pairs.stage(spark, sf).likelihoods.select(
        *KEY, "sample", r("l0", 4), r("l1", 4), r("l2", 4), r("d0"), r("d1"), r("d2")
    )


@query(
    "gt_prior_hwe",
    """SELECT contig, p, len0, round(g0, 6) AS g0, round(g1, 6) AS g1, round(g2, 6) AS g2 FROM state""",
    "state",
)
def gt_prior_hwe(spark, sf):
    return Pairs.stage(spark, sf).seeds.select(*KEY, r("g0"), r("g1"), r("g2"))


@query(
    "gt_prior_somatic",
    """SELECT contig, p, len0,
       round(CASE WHEN af <= 0.4 THEN greatest(1 - 2 * af + 1e-10, 1e-10) ELSE 1e-10 END, 6) AS g0,
       round(CASE WHEN af <= 0.4 THEN greatest(2 * af - 2e-10, 1e-10) WHEN af < 0.75 THEN 1.0 ELSE 1e-10 END, 6) AS g1,
       round(CASE WHEN af < 0.75 THEN 1e-10 ELSE 1.0 END, 6) AS g2 FROM seed WHERE af > 0""",
    "seed",
)
def gt_prior_somatic(spark, sf):
    return em.with_prior(Pairs.stage(spark, sf).seeds, cell_population=True).select(*KEY, r("g0"), r("g1"), r("g2"))


@query("af_update", "SELECT contig, p, len0, round(af, 6) AS af FROM afup", "afup")
def af_update(spark, sf):
    b = Pairs.stage(spark, sf)
    return em.frequency_update(b.likelihoods, b.seeds, N_SAMPLES).select(*KEY, r("af"))


@query("lr_statistic", "SELECT contig, p, len0, round(lr, 4) AS lr FROM lrs", "lrs")
def lr_statistic(spark, sf):
    b = Pairs.stage(spark, sf)
    return em.likelihood_ratio(b.likelihoods, b.seeds, N_SAMPLES).select(*KEY, r("lr", 4))


@query(
    "length_update",
    """SELECT d.contig, d.p, d.len0, round(sum(w), 4) AS weight, round(sum(w * d.dev), 3) AS moment FROM (
  SELECT pd.*, pd.cnt * (p1 / (p0 + p1 + p2) * pd.dl / (pd.dl + pd.ref) + p2 / (p0 + p1 + p2)) AS w
  FROM pd JOIN post t ON pd.contig = t.contig AND pd.p = t.p AND pd.len0 = t.len0 AND pd.sample = t.sample) d
GROUP BY d.contig, d.p, d.len0""",
    "pd", "post",
)
def length_update(spark, sf):
    b = Pairs.stage(spark, sf)
    return em.length_moments(b.densities, b.likelihoods, b.seeds).select(*KEY, r("weight", 4), r("moment", 3))


@query("length_step", LENGTH_STEP, "pd", "post")
def length_step(spark, sf):
    b = Pairs.stage(spark, sf)
    return em.length_update(b.densities, b.likelihoods, b.seeds)


@query("shift_update", SHIFT_STEP, "pd", "state", "mom")
def shift_update(spark, sf):
    b = Pairs.stage(spark, sf)
    groups = em.group_likelihoods(em.log_likelihoods(b.densities, "rg"))
    return em.shift_update(b.densities, groups, b.seeds)


@query(
    "min_likelihood_ratio",
    f"""SELECT contig, p, len0 FROM (SELECT contig, p, len0, round(lr, 4) AS lr FROM lrs)
WHERE lr >= {CHI2_Q99!r} / 2 - ln(0.2::DOUBLE / (1 - 0.2::DOUBLE))""",
    "lrs",
)
def min_likelihood_ratio(spark, sf):
    b = Pairs.stage(spark, sf)
    lr = em.likelihood_ratio(b.likelihoods, b.seeds, N_SAMPLES).select(*KEY, r("lr", 4))
    return lr.where(F.col("lr") >= CallParams(prior=0.2).min_likelihood_ratio).select(*KEY)


@query(
    "load_limits_join",
    """SELECT a.contig, a.p, a.sample, a.rg, a.dev, count(*) AS cnt, max(l.n) AS n,
       max(l.n) >= CASE WHEN a.rg < 5 THEN a.rg + 1 ELSE 4 END AS high_cov
FROM active a JOIN loads l ON a.contig = l.contig AND a.p = l.p AND a.sample = l.sample AND a.rg = l.rg
GROUP BY a.contig, a.p, a.sample, a.rg, a.dev""",
    "active", "loads",
)
def load_limits_join(spark, sf):
    b = Pairs(spark, sf)
    limits = b.pairs.where("rg < 5").select("rg").distinct().withColumn("max_load", F.col("rg") + 1)
    loaded = windows.with_load(windows.deviation_counts(b.active), limits, 4)
    return loaded.select("contig", "p", "sample", "rg", "dev", "cnt", "n", "high_cov")


@query(
    "dad_counts",
    "SELECT * FROM dad",
    "dad",
)
def dad_counts(spark, sf):
    b = Pairs.stage(spark, sf)
    return em.distribution_classes(b.obs, b.seeds, b.density)


@query("lad_counts", "SELECT * FROM lad", "lad")
def lad_counts(spark, sf):
    return em.depth_classes(Pairs.stage(spark, sf).densities)


def _phred(b: Pairs):
    ten = [F.col(f"l{k}") / F.log(F.lit(10.0)) for k in range(3)]
    flat = F.greatest(*ten) - F.least(*ten) < G.EQUAL_WITHIN
    pl = G.phred(*[F.when(flat, F.lit(v)).otherwise(t) for v, t in zip((0.0, -10.0, -10.0), ten, strict=True)])
    low = F.col("n_active") < 2
    zero = F.lit(0).cast("bigint")
    return (
        b.likelihoods.join(b.windows.select("contig", "p", "sample", "n_active"), ["contig", "p", "sample"])
        .select(*KEY, "sample", *[F.when(low, zero).otherwise(pl[k]).alias(f"pl{k}") for k in range(3)])
    )


PL = ["pl0", "pl1", "pl2"]


@query("phred_pl", "SELECT contig, p, len0, sample, pl0, pl1, pl2 FROM pls", "pls")
def phred_pl(spark, sf):
    return _phred(Pairs.stage(spark, sf))


@query(
    "gq_gt_string",
    """SELECT contig, p, len0, sample, CAST(gq AS BIGINT) AS gq,
       CASE WHEN gq = 0 THEN './.' ELSE (CASE WHEN pl2 = 0 THEN '1' ELSE '0' END) || '/' || (CASE WHEN pl0 <> 0 THEN '1' ELSE '0' END) END AS gt,
       CASE WHEN gq = 0 THEN '0,0,0' ELSE concat_ws(',', least(pl0, 255), least(pl1, 255), least(pl2, 255)) END AS pl
FROM gts""",
    "gts",
)
def gq_gt_string(spark, sf):
    pl = [F.col(c) for c in PL]
    return _phred(Pairs.stage(spark, sf)).select(
        *KEY, "sample", G.genotype_quality(*pl).alias("gq"), G.genotype_string(*pl).alias("gt"),
        G.phred_string(*pl).alias("pl"),
    )


@query(
    "allele_freq_from_gt",
    """SELECT contig, p, len0, round(CAST(sum(CASE WHEN pl0 = 0 THEN 0 WHEN pl1 = 0 THEN 1 ELSE 2 END) AS DOUBLE) / 10.0, 6) AS af,
       round(CASE WHEN sum(n) = 0 THEN 0.0::DOUBLE ELSE CAST(sum(CASE WHEN pl0 = 0 THEN 0 WHEN pl1 = 0 THEN 1 WHEN pl2 = 0 THEN 2 ELSE 0 END) AS DOUBLE) / CAST(sum(n) AS DOUBLE) END, 6) AS af_known
FROM (SELECT *, CASE WHEN pl0 = 0 AND pl1 = 0 THEN 0 ELSE 2 END AS n FROM pls) GROUP BY contig, p, len0""",
    "pls",
)
def allele_freq_from_gt(spark, sf):
    pl = [F.col(c) for c in PL]
    deleted, known = G.known_allele_counts(*pl)
    sums = _phred(Pairs.stage(spark, sf)).groupBy(*KEY).agg(
        F.sum(G.allele_count(*pl[:2])).alias("alleles"), F.sum(deleted).alias("deleted"), F.sum(known).alias("n")
    )
    share = F.when(F.col("n") == 0, F.lit(0.0)).otherwise(F.try_divide("deleted", "n"))
    return sums.select(
        *KEY, F.round(F.col("alleles") / F.lit(2.0 * N_SAMPLES), 6).alias("af"), F.round(share, 6).alias("af_known")
    )


@query(
    "yield_fraction",
    """SELECT contig, p, len0, round(count(*) FILTER (WHERE pl0 + pl1 + pl2 <> 0) / 5.0::DOUBLE, 6) AS yield
FROM pls GROUP BY contig, p, len0""",
    "pls",
)
def yield_fraction(spark, sf):
    data = G.has_data(*[F.col(c) for c in PL])
    return _phred(Pairs.stage(spark, sf)).groupBy(*KEY).agg(
        F.round(F.count_if(data) / F.lit(float(N_SAMPLES)), 6).alias("yield")
    )


@query(
    "filter_string",
    """SELECT contig, p, len0, bits, CASE WHEN bits = 0 THEN 'PASS' ELSE concat_ws(';',
         CASE WHEN bits & 1 <> 0 THEN 'lowLR' END, CASE WHEN bits & 2 <> 0 THEN 'highCov' END,
         CASE WHEN bits & 4 <> 0 THEN 'missingSamples' END, CASE WHEN bits & 8 <> 0 THEN 'allRefGT' END,
         CASE WHEN bits & 16 <> 0 THEN 'CSWin' END) END AS filter
FROM (SELECT s.contig, s.p, s.len0,
        CAST((CASE WHEN l.lr < 1 THEN 1 ELSE 0 END)
        + (CASE WHEN d.data_samples / 5.0::DOUBLE < 0.6::DOUBLE THEN 4 ELSE 0 END)
        + (CASE WHEN a.alleles = 0 THEN 8 ELSE 0 END)
        + (CASE WHEN 30.0::DOUBLE / s.len0 < 0.5::DOUBLE THEN 16 ELSE 0 END) AS BIGINT) AS bits
      FROM state s JOIN (SELECT contig, p, len0, round(lr, 4) AS lr FROM lrs) l ON s.contig = l.contig AND s.p = l.p AND s.len0 = l.len0
      JOIN (SELECT contig, p, count(*) FILTER (WHERE n_active >= 2) AS data_samples FROM sampled GROUP BY contig, p) d
        ON s.contig = d.contig AND s.p = d.p
      JOIN (SELECT contig, p, len0, sum(CASE WHEN pl0 = 0 THEN 0 WHEN pl1 = 0 THEN 1 ELSE 2 END) AS alleles
            FROM pls GROUP BY contig, p, len0) a ON s.contig = a.contig AND s.p = a.p AND s.len0 = a.len0)""",
    "state", "lrs", "sampled", "pls",
)
def filter_string(spark, sf):
    b = Pairs.stage(spark, sf)
    lr = em.likelihood_ratio(b.likelihoods, b.seeds, N_SAMPLES).select(*KEY, r("lr", 4))
    data = b.windows.groupBy("contig", "p").agg(F.count_if(F.col("n_active") >= 2).alias("data_samples"))
    alleles = _phred(b).groupBy(*KEY).agg(F.sum(G.allele_count(F.col("pl0"), F.col("pl1"))).alias("alleles"))
    bit = lambda test, value: F.when(test, F.lit(value)).otherwise(F.lit(0))
    bits = (
        bit(F.col("lr") < 1, G.FILTER_LR)
        .bitwiseOR(bit(F.col("data_samples") / F.lit(float(N_SAMPLES)) < 0.6, G.FILTER_SAMPLES))
        .bitwiseOR(bit(F.col("alleles") == 0, G.FILTER_ALL_REF))
        .bitwiseOR(bit(F.lit(30.0) / F.col("len0") < 0.5, G.FILTER_WINDOW_COVER))
        .cast("bigint")
    )
    rows = b.seeds.select(*KEY).join(lr, KEY).join(data, ["contig", "p"]).join(alleles, KEY)
    return rows.withColumn("bits", bits).select(*KEY, "bits", G.filter_string(F.col("bits")).alias("filter"))


@query(
    "qual_asof",
    """SELECT e.event_id, CAST(max(l.q) AS BIGINT) AS qual,
       round(CASE WHEN max(l.q) >= 100 THEN 1.0 ELSE 1 - pow(10.0, -max(l.q) / 10.0::DOUBLE) END, 8) AS prob
FROM events e JOIN ladder l ON l.k <= e.value / 4 GROUP BY e.event_id""",
    "ladder",
)
def qual_asof(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "value")
    rated = events.select("event_id", G.call_quality(F.col("value") / 4).alias("qual"))
    return rated.withColumn("prob", F.round(G.quality_probability(F.col("qual")), 8))


# ---------------------------------------------------------------- bins


@query("bin256", "SELECT contig, rg, CAST(start // 256 * 256 AS BIGINT) AS win, count(*) AS n, CAST(max(start - start // 256 * 256) AS BIGINT) AS max_off FROM b1 GROUP BY contig, rg, start // 256 * 256", "b1")
def bin256(spark, sf):
    win = windows.profile_bin(F.col("start"))
    return (
        Pairs(spark, sf).pairs.withColumn("win", win).groupBy("contig", "rg", "win")
        .agg(F.count(F.lit(1)).alias("n"), F.max(F.col("start") - F.col("win")).alias("max_off"))
    )


@query("bin30", "SELECT contig, rg, CAST(start // 30 * 30 AS BIGINT) AS win, count(*) AS n FROM b1 GROUP BY contig, rg, start // 30 * 30", "b1")
def bin30(spark, sf):
    win = windows.grid_bin(F.col("start"))
    return Pairs(spark, sf).pairs.groupBy("contig", "rg", win.alias("win")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "admitted_pairs",
    "SELECT contig, rg, start, dev, last_win, count(*) AS n FROM admission WHERE kept GROUP BY contig, rg, start, dev, last_win",
    "admission",
)
def admitted_pairs(spark, sf):
    """At most three open pairs per read group, over tiles of 3000 positions."""
    got = admission.admitted_pairs(Pairs(spark, sf).spanned, None, 3, tile=3000)
    return got.groupBy("contig", "rg", "start", "dev", "last_win").agg(F.count("*").alias("n"))


@query("pair_last_window", "SELECT contig, sample, rg, start, isize, dev, end_pos, last_win FROM pairs", "pairs")
def pair_last_window(spark, sf):
    return Pairs(spark, sf).spanned.select("contig", "sample", "rg", "start", "isize", "dev", "end_pos", "last_win")


@query(
    "chunk_genome",
    """SELECT contig, CAST(i * 10000 AS BIGINT) AS beg, CAST(least(i * 10000 + 10000 + 90, len) AS BIGINT) AS "end",
       'out.' || contig || '.' || (i * 10000) || '-' || least(i * 10000 + 10000 + 90, len) || '.profile' AS file
FROM (SELECT contig, len, unnest(generate_series(0, len // 10000)) AS i FROM (
  SELECT contig, max(end_pos) AS len FROM pairs GROUP BY contig))""",
    "pairs",
)
def chunk_genome(spark, sf):
    from lacuna.functions.regions import chunk_file_name

    contigs = Pairs(spark, sf).spanned.groupBy("contig").agg(F.max("end_pos").alias("len"))
    parts = intervals.chunks(contigs, 10_000, 90)
    return parts.withColumn("file", chunk_file_name(F.lit("out"), F.col("contig"), F.col("beg"), F.col("end")))


@query(
    "roi_filter",
    """SELECT p.contig, p.start, p.rg, CAST(p.start // 256 * 256 AS BIGINT) AS win FROM b1 p
JOIN (SELECT contig, min(start) + 1000 AS beg, max(start) - 5000 AS "end" FROM b1 GROUP BY contig) r ON p.contig = r.contig
WHERE p.start // 256 * 256 >= r.beg AND p.start // 256 * 256 < r."end" """,
    "b1",
)
def roi_filter(spark, sf):
    pairs = Pairs(spark, sf).pairs
    regions = pairs.groupBy("contig").agg((F.min("start") + 1000).alias("beg"), (F.max("start") - 5000).alias("end"))
    rows = pairs.select("contig", "start", "rg", windows.profile_bin(F.col("start")).alias("win"))
    return intervals.windows_in_regions(rows, "win", regions)


# ---------------------------------------------------------------- whole model (no SQL equivalent)

SMALL = CallParams(min_lr=0.5, min_init_len=20, min_len=20)


@query("window_calls_em")
def window_calls_em(spark, sf):
    rows = Pairs.stage(spark, sf).genotyped(SMALL)
    return rows.where("lead").select(*KEY, "iterations", "len", r("lr", 4), r("af", 4), "data_samples")


for _rounds in (1, 2):

    @query(f"window_calls_em_{_rounds}", *(lambda n: (f"SELECT * FROM {n}", n))(unrolled_estimation(_rounds, MIN_LEN, 0.5)))
    def window_calls_rounds(spark, sf, rounds=_rounds):
        """The estimation stopped after a few rounds, which SQL can write out."""
        rows = Pairs.stage(spark, sf).genotyped(replace(SMALL, iterations=rounds))
        return rows.where("lead").select(*KEY, "iterations", "len", r("lr", 4), r("af", 4), "data_samples")


@query("window_calls_blocks", *(lambda n: (f"SELECT * FROM {n}", n))(unrolled_estimation(2, MIN_LEN, 0.5)))
def window_calls_blocks(spark, sf):
    """Two rounds of the estimation over blocks of two samples."""
    rows = Pairs.stage(spark, sf).genotyped(replace(SMALL, iterations=2), block_samples=2)
    return rows.where("lead").select(*KEY, "iterations", "len", r("lr", 4), r("af", 4), "data_samples")


def _merged(spark, sf, params=SMALL, cover=0.0, keep_failed=True):
    from lacuna.session import materialise

    b = Pairs.stage(spark, sf)
    genotyped = materialise(b.genotyped(params))
    positions = genotyping.supported(genotyped, b.spanned, b.hot, b.density)
    calls = genotyping.window_calls(genotyped, positions, N_SAMPLES, params.min_sample_fraction)
    calls = genotyping.with_segments(calls, genotyping.first_grid_points(b.spanned), 10_000)
    return merging.merge_calls(calls, genotyped, 50.0, N_SAMPLES, cover, keep_failed=keep_failed)


def _unified(calls):
    return calls.select(*merging.CALL, "pos", "len", r("lr", 4), r("af", 4), "sig_windows", "filter")


@query("unify_calls")
def unify_calls(spark, sf):
    return _unified(_merged(spark, sf)[0])


@query("call_genotypes")
def call_genotypes(spark, sf):
    _, samples = _merged(spark, sf)
    return samples.select(*merging.CALL, "sample", "pl0", "pl1", "pl2", "lad_ref", "lad_amb", "lad_del", "first", "last")


# the whole way to calls, with two rounds of the estimation and filters that act
TWO_ROUNDS = replace(SMALL, iterations=2, min_sample_fraction=0.6)
estimated_calls(2, MIN_LEN, 0.5, TWO_ROUNDS.min_sample_fraction)


@query(
    "unify_calls_2",
    """SELECT contig, segment, cluster, pos, len, round(lr, 4) AS lr, round(af, 4) AS af, sig_windows, filter
FROM calls_est WHERE filter = 0""",
    "calls_est",
)
def unify_calls_2(spark, sf):
    """Calls that pass every filter: enough samples with data and windows that cover half of the deletion."""
    return _unified(_merged(spark, sf, TWO_ROUNDS, 0.5, keep_failed=False)[0])


@query(
    "call_genotypes_2",
    f"SELECT contig, segment, cluster, sample, pl0, pl1, pl2, {', '.join(COUNTS)}, first, last FROM cells_est",
    "cells_est",
)
def call_genotypes_2(spark, sf):
    _, samples = _merged(spark, sf, TWO_ROUNDS, 0.5, keep_failed=False)
    return samples.select(*merging.CALL, "sample", *PL, *COUNTS, "first", "last")


@query(
    "padded_median",
    """SELECT contig, sample, win, CAST(CASE WHEN (count(*) + 3) // 2 - 3 < 0 THEN 0
         ELSE list_sort(list(lad_ref))[(count(*) + 3) // 2 - 3 + 1] END AS BIGINT) AS lad_ref
FROM (SELECT *, CAST(p // 3000 * 3000 AS BIGINT) AS win FROM lad) GROUP BY contig, sample, win""",
    "lad",
)
def padded_median(spark, sf):
    from lacuna.functions.arrays import padded_upper_median

    rows = em.depth_classes(Pairs.stage(spark, sf).densities).withColumn("win", windows.bin_start(F.col("p"), 3000))
    listed = rows.groupBy("contig", "sample", "win").agg(
        F.array_sort(F.collect_list("lad_ref")).alias("listed"), (F.count(F.lit(1)) + 3).alias("n")
    )
    return listed.select("contig", "sample", "win", padded_upper_median(F.col("listed"), F.col("n")).alias("lad_ref"))


# ---------------------------------------------------------------- clustering of made-up window calls

SIGMA = 10.0


def _window_calls(b: Pairs):
    seg = genotyping.with_segments(b.candidates, genotyping.first_grid_points(b.spanned), 10_000)
    return seg.select(
        "contig", "segment", "p", "len0",
        (F.col("p") - 1).alias("win_pos"),
        (F.col("p") + F.col("len0") % 7 * 5).alias("pos"),
        F.expr("p + len0 * (p div 30 % 3) div 2").alias("end_pos"),
        F.col("len0").alias("len"),
        (F.col("len0") % 11).cast("double").alias("lr"),
        F.lit(1).cast("bigint").alias("iterations"),
        F.expr("if(p div 30 % 4 = 0, 4L, 0L)").alias("filter"),
    )


@query("cluster_calls", "SELECT contig, segment, cluster, p, len0, head FROM clustered", "clustered")
def cluster_calls(spark, sf):
    rows = merging.cluster_calls(_window_calls(Pairs.stage(spark, sf)), SIGMA)
    return rows.select(*merging.CALL, "p", "len0", "head")


@query("cluster_calls_all", "SELECT contig, segment, cluster, p, len0, head FROM clustered_all", "clustered_all")
def cluster_calls_all(spark, sf):
    """Failed window calls may open a cluster too."""
    rows = merging.cluster_calls(_window_calls(Pairs.stage(spark, sf)), SIGMA, keep_failed=True)
    return rows.select(*merging.CALL, "p", "len0", "head")


@query(
    "merged_positions",
    "SELECT contig, segment, cluster, pos, len, round(lr, 6) AS lr, sig_windows, CAST(filter AS BIGINT) AS filter FROM mergedpos",
    "mergedpos",
)
def merged_positions(spark, sf):
    clustered = merging.cluster_calls(_window_calls(Pairs.stage(spark, sf)), SIGMA)
    rows = merging.merged_positions(clustered, 0.5)
    return rows.select(*merging.CALL, "pos", "len", r("lr"), "sig_windows", "filter")


@query(
    "merged_genotypes",
    "SELECT contig, segment, cluster, sample, n_windows, pl0, pl1, pl2, lad_ref, lad_del FROM mgt",
    "mgt",
)
def merged_genotypes(spark, sf):
    b = Pairs.stage(spark, sf)
    clustered = merging.cluster_calls(_window_calls(b), SIGMA)
    members = merging.genotype_members(clustered, merging.merged_positions(clustered, 0.5))
    keys = [*KEY, "sample"]
    depths = em.depth_classes(b.densities).join(em.distribution_classes(b.obs, b.seeds, b.density), keys)
    rows = merging.call_genotypes(members, _phred(b).join(depths, keys))
    return rows.select(*merging.CALL, "sample", "n_windows", *PL, "lad_ref", "lad_del")


@query(
    "call_filter",
    "SELECT contig, segment, cluster, pos, len, round(af, 6) AS af FROM calls WHERE filter = 0",
    "calls",
)
def call_filter(spark, sf):
    """Calls that pass, with the frequency of their merged genotypes."""
    b = Pairs.stage(spark, sf)
    clustered = merging.cluster_calls(_window_calls(b), SIGMA)
    merged = merging.merged_positions(clustered, 0.5)
    keys = [*KEY, "sample"]
    depths = em.depth_classes(b.densities).join(em.distribution_classes(b.obs, b.seeds, b.density), keys)
    samples = merging.call_genotypes(merging.genotype_members(clustered, merged), _phred(b).join(depths, keys))
    called = merging.finish_calls(merged, samples, N_SAMPLES).where("filter = 0")
    return called.select(*merging.CALL, "pos", "len", r("af"))


@query(
    "merge_windows_islands",
    """SELECT contig, segment, CAST(island AS BIGINT) AS island, count(*) AS n, list_sort(list(len0))[count(*) // 2 + 1] AS len,
       list_sort(list(p))[count(*) // 2 + 1] AS pos FROM (
  SELECT *, sum(opens) OVER (PARTITION BY contig, segment ORDER BY p, len0) AS island FROM (
    SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY contig, segment ORDER BY p, len0) <= 90 THEN 0 ELSE 1 END AS opens FROM (
      SELECT c.contig, c.p, c.len0, CAST((c.p - f.first_p) // 10000 AS BIGINT) AS segment FROM cand c
      JOIN (SELECT contig, min(start // 30 * 30) AS first_p FROM b1 GROUP BY contig) f ON c.contig = f.contig)))
GROUP BY contig, segment, island HAVING count(*) >= 2""",
    "cand", "b1",
)
def merge_windows_islands(spark, sf):
    from pyspark.sql import Window

    from lacuna.functions.arrays import upper_median

    b = Pairs.stage(spark, sf)
    seg = genotyping.with_segments(b.candidates, genotyping.first_grid_points(b.spanned), 10_000)
    axis = Window.partitionBy("contig", "segment").orderBy("p", "len0")
    opens = F.coalesce(F.col("p") - F.lag("p").over(axis) > 90, F.lit(True)).cast("int")
    return (
        seg.withColumn("opens", opens)
        .withColumn("island", F.sum("opens").over(axis))
        .groupBy("contig", "segment", "island")
        .agg(
            F.count(F.lit(1)).alias("n"),
            upper_median(F.array_sort(F.collect_list("len0"))).alias("len"),
            upper_median(F.array_sort(F.collect_list("p"))).alias("pos"),
        )
        .where("n >= 2")
    )


@query(
    "median_lad",
    """SELECT contig, sample, win, count(*) AS n, list_sort(list(lad_ref))[count(*) // 2 + 1] AS lad_ref,
       list_sort(list(lad_amb))[count(*) // 2 + 1] AS lad_amb, list_sort(list(lad_del))[count(*) // 2 + 1] AS lad_del
FROM (SELECT *, CAST(p // 3000 * 3000 AS BIGINT) AS win FROM lad) GROUP BY contig, sample, win""",
    "lad",
)
def median_lad(spark, sf):
    from lacuna.functions.arrays import upper_median

    rows = em.depth_classes(Pairs.stage(spark, sf).densities).withColumn("win", windows.bin_start(F.col("p"), 3000))
    middle = lambda c: upper_median(F.array_sort(F.collect_list(c))).alias(c)
    return rows.groupBy("contig", "sample", "win").agg(
        F.count(F.lit(1)).alias("n"), middle("lad_ref"), middle("lad_amb"), middle("lad_del")
    )
