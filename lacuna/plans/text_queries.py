"""Queries that end in text: profile and histogram views, variant records."""

from __future__ import annotations

from pyspark.sql import functions as F

from lacuna import __version__
from lacuna.functions import text as T
from lacuna.operators import em, genotyping, reads, render
from lacuna.plans.pair_queries import TWO_ROUNDS, _merged, _phred
from lacuna.plans.registry import query
from lacuna.plans.stand_ins import N_SAMPLES, Pairs

GROUPS = list(range(10))
PROFILE_CELLS = ", ".join(
    f"coalesce(max(CASE WHEN rg = {g} THEN cell END), '.')" for g in GROUPS
)


@query(
    "profile_text_view",
    f"""SELECT contig, win, contig || chr(9) || (win + 1) || chr(9) || concat_ws(chr(9), {PROFILE_CELLS}) AS line FROM (
  SELECT contig, win, rg, string_agg(off || ':' || dev, ',' ORDER BY off, dev) AS cell FROM (
    SELECT contig, rg, CAST(start // 256 * 256 AS BIGINT) AS win, start - start // 256 * 256 AS off, dev FROM pairs)
  GROUP BY contig, win, rg) GROUP BY contig, win""",
    "pairs",
)
def profile_text_view(spark, sf):
    b = Pairs(spark, sf)
    profile = reads.to_profile(b.pairs, b.medians)
    return render.profile_lines(profile, GROUPS)


@query(
    "profile_round_trip",
    "SELECT contig, rg, start, isize, count(*) AS n FROM b1 GROUP BY contig, rg, start, isize",
    "b1",
)
def profile_round_trip(spark, sf):
    b = Pairs(spark, sf)
    pairs = reads.from_profile(reads.to_profile(b.pairs, b.medians), b.medians)
    return pairs.groupBy("contig", "rg", "start", "isize").agg(F.count(F.lit(1)).alias("n"))


@query(
    "sample_rg_join",
    """SELECT b.contig, CAST(b.start // 256 * 256 AS BIGINT) AS win, b.sample, b.rg % 2 AS rg,
  CAST(b.start - b.start // 256 * 256 AS BIGINT) AS off, b.isize - m.median AS dev, count(*) AS n
FROM b1 b JOIN (SELECT sample, rg % 2 AS rg, min(isize) AS median FROM b1 GROUP BY sample, rg % 2) m
  ON b.sample = m.sample AND b.rg % 2 = m.rg GROUP BY ALL""",
    "b1",
)
def sample_rg_join(spark, sf):
    """Samples that share identifiers: profiles are keyed by sample and read group."""
    pairs = Pairs(spark, sf).pairs.withColumn("rg", F.col("rg") % 2)
    stats = pairs.groupBy("sample", "rg").agg(F.min("isize").alias("median"))
    profile = reads.to_profile(pairs, stats)
    return profile.groupBy(*profile.columns).agg(F.count(F.lit(1)).alias("n"))


HIST_CELLS = ", ".join(
    f"coalesce(max(CASE WHEN s.rg = {g} THEN CAST(coalesce(h.cnt, 0) AS VARCHAR) END), 'NA')" for g in GROUPS
)


@query(
    "histogram_text_view",
    f"""SELECT a.size, a.size || chr(9) || concat_ws(chr(9), {HIST_CELLS}) AS line
FROM (SELECT CAST(unnest(generate_series(min(lo), max(hi) - 1)) AS BIGINT) AS size FROM borders) a
LEFT JOIN spine s ON s.size = a.size LEFT JOIN hist h ON h.rg = s.rg AND h.size = s.size GROUP BY a.size""",
    "borders", "spine", "hist",
)
def histogram_text_view(spark, sf):
    b = Pairs(spark, sf)
    return render.histogram_lines(b.hist, b.borders, GROUPS)


@query(
    "six_digit_text",
    """SELECT event_id, CASE WHEN value = 0 THEN '0' ELSE printf('%g', value / 7) END AS coarse,
       CASE WHEN value = 0 THEN '0' ELSE printf('%g', value / 700000) END AS fine,
       CASE WHEN value = 0 THEN '0' ELSE printf('%g', value * 30011) END AS large FROM events""",
)
def six_digit_text(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "value")
    v = F.col("value")
    return events.select(
        "event_id", T.six_digits(v / 7).alias("coarse"), T.six_digits(v / 700000).alias("fine"),
        T.six_digits(v * 30011).alias("large"),
    )


# One sample of a call; reads pl0 to pl2, gq, the counts and the borders under the given names.
def cell_sql(first: str, last: str) -> str:
    return f"""concat_ws(':', CASE WHEN gq = 0 THEN './.' ELSE (CASE WHEN pl2 = 0 THEN '1' ELSE '0' END) || '/' || (CASE WHEN pl0 <> 0 THEN '1' ELSE '0' END) END,
          CASE WHEN gq = 0 THEN '0,0,0' ELSE concat_ws(',', least(pl0, 255), least(pl1, 255), least(pl2, 255)) END,
          gq, concat_ws(',', lad_ref, lad_amb, lad_del),
          concat_ws(',', dad_ref, dad_both, dad_between, dad_alt, dad_right),
          concat_ws(',', {first}, {last}), {last} - {first})"""


ABSENT = "./.:0,0,0:0:0,0,0:0,0,0,0,0:0,0:0"
SAMPLE_CELLS = ", ".join(f"coalesce(max(CASE WHEN c.sample = {s} THEN c.cell END), '{ABSENT}')" for s in range(5))


@query(
    "vcf_records",
    f"""SELECT s.contig, s.p - 1 AS pos, s.len0 AS len, concat_ws(chr(9), s.contig,
    CASE WHEN s.p - 1 > 1 THEN s.p - 1 ELSE s.p END, '.', 'N', '<DEL>', max(r.q), 'PASS',
    'IMPRECISE;SVLEN=-' || s.len0 || ';END=' || (s.p - 1 + s.len0) || ';SVTYPE=DEL;AF=' || printf('%g', s.af)
      || ';LR=' || printf('%g', max(r.lr)) || ';SVMETHOD=lacuna-{__version__};YIELD='
      || printf('%g', count(*) FILTER (WHERE c.has_data) / 5.0::DOUBLE) || ';SWIN=0',
    'GT:PL:GQ:LAD:DAD:FL:FLD', {SAMPLE_CELLS}) AS line
FROM state s
JOIN (SELECT l.contig, l.p, l.len0, max(l.lr) AS lr, max(k.q) AS q FROM (SELECT contig, p, len0, round(greatest(lr, 0), 3) AS lr FROM lrs) l
      JOIN ladder k ON k.k <= l.lr GROUP BY l.contig, l.p, l.len0) r ON s.contig = r.contig AND s.p = r.p AND s.len0 = r.len0
JOIN (SELECT g.contig, g.p, g.len0, g.sample, g.pl0 + g.pl1 + g.pl2 <> 0 AS has_data,
        {cell_sql('f.first_pos', 'f.last_pos')} AS cell
      FROM gts g JOIN lad l ON g.contig = l.contig AND g.p = l.p AND g.len0 = l.len0 AND g.sample = l.sample
      JOIN dad d ON g.contig = d.contig AND g.p = d.p AND g.len0 = d.len0 AND g.sample = d.sample
      JOIN (SELECT contig, p, sample, min(first_pos) AS first_pos, max(last_pos) AS last_pos FROM loads GROUP BY contig, p, sample) f
        ON g.contig = f.contig AND g.p = f.p AND g.sample = f.sample) c
  ON s.contig = c.contig AND s.p = c.p AND s.len0 = c.len0
GROUP BY s.contig, s.p, s.len0, s.af""",
    "state", "lrs", "ladder", "gts", "lad", "dad", "loads",
)
def vcf_records(spark, sf):
    b = Pairs.stage(spark, sf)
    lr = em.likelihood_ratio(b.likelihoods, b.seeds, N_SAMPLES).select(
        *em.KEY, F.round(F.greatest(F.col("lr"), F.lit(0.0)), 3).alias("lr")
    )
    calls = b.seeds.select(*em.KEY, "af").join(lr, em.KEY).select(
        *em.KEY, (F.col("p") - 1).alias("pos"), F.col("len0").alias("len"), "lr", "af",
        F.lit(0).alias("sig_windows"), F.lit(0).alias("filter"),
    )
    key = [*em.KEY, "sample"]
    samples = (
        _phred(b)
        .join(em.depth_classes(b.densities), key)
        .join(em.distribution_classes(b.obs, b.seeds, b.density), key)
        .join(b.windows.select("contig", "p", "sample", "first", "last"), ["contig", "p", "sample"])
    )
    order = genotyping.sample_order(b.windows)
    lines = render.vcf_lines(
        calls, render.call_cells(samples, em.KEY), order, N_SAMPLES, em.KEY, F.lit(ABSENT), False
    )
    return lines


# A passing call and, where failed ones are kept, those with too few samples (4) or windows (16).
FILTER_TEXT = """CASE WHEN m.filter = 0 THEN 'PASS'
      ELSE concat_ws(';', CASE WHEN m.filter & 4 <> 0 THEN 'missingSamples' END, CASE WHEN m.filter & 16 <> 0 THEN 'CSWin' END) END"""


@query(
    "merged_vcf_records",
    f"""SELECT m.contig, m.pos, m.len, concat_ws(chr(9), m.contig,
    CASE WHEN m.pos > 1 THEN m.pos ELSE m.pos + 1 END, '.', 'N', '<DEL>', max(k.q), {FILTER_TEXT},
    'IMPRECISE;SVLEN=-' || m.len || ';END=' || (m.pos + m.len) || ';SVTYPE=DEL;AF=' || CASE WHEN m.af = 0 THEN '0' ELSE printf('%g', m.af) END
      || ';LR=' || printf('%g', m.lr) || ';SVMETHOD=lacuna-{__version__};YIELD='
      || printf('%g', (max(c.covered) + 5 - max(c.present)) / 5.0::DOUBLE) || ';SWIN=' || m.sig_windows,
    'GT:PL:GQ:LAD:DAD:FL:FLD', max(c.cells)) AS line
FROM calls_estall m JOIN ladder k ON k.k <= m.lr
JOIN (SELECT contig, segment, cluster, count(*) AS present, count(*) FILTER (WHERE pl0 + pl1 + pl2 <> 0) AS covered,
             concat_ws(chr(9), {SAMPLE_CELLS}) AS cells
      FROM (SELECT *, {cell_sql('first', 'last')} AS cell FROM (
        SELECT *, CASE WHEN pl0 + pl1 + pl2 = 0 THEN 0 ELSE least(255, CASE WHEN pl0 = 0 THEN least(pl1, pl2)
                    WHEN pl1 = 0 THEN least(pl0, pl2) ELSE least(pl0, pl1) END) END AS gq FROM cells_estall)) c
      GROUP BY contig, segment, cluster) c
  ON c.contig = m.contig AND c.segment = m.segment AND c.cluster = m.cluster
GROUP BY m.contig, m.segment, m.cluster, m.pos, m.len, m.af, m.lr, m.filter, m.sig_windows""",
    "calls_estall", "ladder", "cells_estall",
)
def merged_vcf_records(spark, sf):
    """Lines of merged calls, failed ones kept, with cells for samples without data in any window."""
    calls, samples = _merged(spark, sf, TWO_ROUNDS, 0.5, keep_failed=True)
    order = genotyping.sample_order(Pairs(spark, sf).pairs)
    return render.merged_vcf_lines(calls, samples, order, N_SAMPLES)
