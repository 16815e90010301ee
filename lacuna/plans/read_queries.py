"""Queries over alignment records, histograms and intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from lacuna.functions import density as D
from lacuna.functions import reads as R
from lacuna.functions import regions
from lacuna.operators import histograms, intervals, reads
from lacuna.params import ProfileParams, ReadQuality
from lacuna.plans.registry import query
from lacuna.plans.stand_ins import Intervals, Reads, big

GATE = ReadQuality(min_mapq=0, min_unclipped=10, min_rel_score=0.8)
PROFILE = ProfileParams(max_deletion=100, quality=GATE)


def _records(spark, sf):
    """Alignment records with clips at either end, depending on the record."""
    base = Reads(spark, sf).reads
    op = lambda test: F.when(test, F.lit("S")).otherwise(F.lit("M"))
    part = lambda o, n: F.struct(o.alias("op"), n.cast("int").alias("n"))
    return base.withColumns(
        {
            "cigar": F.array(
                part(op(F.col("suppkey") % 2 == 0), F.col("mapq")),
                part(F.lit("M"), F.col("l_seq")),
                part(op(F.col("suppkey") % 3 == 0), F.col("mapq")),
            ),
            "mate_contig": F.col("contig"),
            "mate_pos": F.col("pos"),
            "tlen": F.col("size"),
            "as_score": big("l_seq * 0.75"),
        }
    )


LEFT = "(CASE WHEN suppkey % 2 = 0 THEN mapq ELSE 0 END)"
RIGHT = "(CASE WHEN suppkey % 3 = 0 THEN mapq ELSE 0 END)"
SPAN = f"(l_seq + 2 * mapq - {LEFT} - {RIGHT})"
GATE_SQL = (
    f"l_seq - {LEFT} - {RIGHT} >= 10 AND CAST(floor(l_seq * 0.75) AS BIGINT) >= "
    f"(l_seq - {LEFT} - {RIGHT}) * 0.8::DOUBLE"
)


@query(
    "flag_mask_filter",
    """SELECT flag, count(*) AS n, (flag & 3868) = 0 AND (flag & 33) = 33 AS forward,
       (flag & 3884) = 0 AND (flag & 17) = 17 AS reverse, (flag & 3884) = 0 AS is_reverse
FROM reads GROUP BY flag""",
    "reads",
)
def flag_mask_filter(spark, sf):
    flag = F.col("flag")
    return (
        Reads(spark, sf).reads.groupBy("flag").agg(F.count(F.lit(1)).alias("n"))
        .select(
            "flag", "n",
            R.flags_pass(flag, ReadQuality().forward()).alias("forward"),
            R.flags_pass(flag, ReadQuality().reverse()).alias("reverse"),
            R.is_reverse(flag).alias("is_reverse"),
        )
    )


@query(
    "clip_quality_filter",
    f"""SELECT qname, line, pos, price, CAST({LEFT} AS BIGINT) AS left_clip, CAST({RIGHT} AS BIGINT) AS right_clip,
       CAST({SPAN} AS BIGINT) AS ref_len
FROM reads WHERE (flag & 3868) = 0 AND (flag & 33) = 33 AND {GATE_SQL}""",
    "reads",
)
def clip_quality_filter(spark, sf):
    cigar = F.col("cigar")
    return _records(spark, sf).where(R.passes(GATE)).select(
        "qname", "line", "pos", "price",
        R.left_clip(cigar).cast("bigint").alias("left_clip"),
        R.right_clip(cigar).cast("bigint").alias("right_clip"),
        R.reference_length(cigar).cast("bigint").alias("ref_len"),
    )


MATES = f"""fwd AS (SELECT * FROM (
  SELECT r.*, pos + {SPAN} AS inner_begin, pos - {LEFT} AS insert_begin,
         row_number() OVER (PARTITION BY qname, r.contig ORDER BY pos DESC, pos + {SPAN} DESC, pos - {LEFT} DESC, r.rg DESC) AS rn
  FROM reads r JOIN rmed USING (rg) JOIN rmom USING (rg)
  WHERE (flag & 3868) = 0 AND (flag & 33) = 33 AND {GATE_SQL} AND size <= CAST(floor(median + 2 * stddev + 100) AS BIGINT)) WHERE rn = 1),
rev AS (SELECT * FROM (
  SELECT r.*, pos + {SPAN} + {RIGHT} AS insert_end,
         row_number() OVER (PARTITION BY qname, contig ORDER BY pos, pos + {SPAN} + {RIGHT}, rg) AS rn
  FROM reads r WHERE (flag & 3884) = 0 AND (flag & 17) = 17 AND {GATE_SQL}) WHERE rn = 1)"""


def _mates_sql(select: str) -> str:
    from lacuna.plans.oracle import with_ctes

    head = with_ctes("", "rmed", "rmom")
    return f"{head.rstrip()},\n{MATES}\n{select}"


def _stats(b: Reads):
    return histograms.lower_median(b.hist).join(histograms.moments(b.hist).select("rg", "stddev"), "rg")


@query(
    "mate_pairs",
    _mates_sql(
        """SELECT f.qname, f.contig, f.rg, v.rg AS rev_rg, f.pos AS fwd_pos, v.pos AS rev_pos,
       CAST(f.inner_begin AS BIGINT) AS inner_begin
FROM fwd f JOIN rev v ON f.qname = v.qname AND f.contig = v.contig WHERE f.pos <= v.pos"""
    ),
)
def mate_pairs(spark, sf):
    records = _records(spark, sf)
    forward = reads.forward_mates(records, _stats(Reads(spark, sf)), PROFILE)
    mates = reads.pair_mates(forward, reads.reverse_mates(records, PROFILE))
    return mates.select("qname", "contig", "rg", "rev_rg", "fwd_pos", "rev_pos", "inner_begin")


@query(
    "insert_size",
    _mates_sql(
        """SELECT f.contig, v.rg, CAST(f.inner_begin AS BIGINT) AS start, CAST(v.insert_end - f.insert_begin AS BIGINT) AS isize
FROM fwd f JOIN rev v ON f.qname = v.qname AND f.contig = v.contig WHERE f.pos <= v.pos"""
    ),
)
def insert_size(spark, sf):
    return reads.read_pairs(_records(spark, sf), _stats(Reads(spark, sf)), PROFILE)


@query(
    "read_length",
    """SELECT qname, line, pos, price, CASE WHEN line % 3 = 0 THEN l_seq + mapq + (CASE WHEN line % 2 = 0 THEN 0 ELSE l_seq END) ELSE l_seq END AS read_len
FROM reads""",
    "reads",
)
def read_length(spark, sf):
    op = lambda test: F.when(test, F.lit("H")).otherwise(F.lit("M"))
    cigar = F.array(
        F.struct(op(F.col("line") % 3 == 0).alias("op"), F.col("mapq").alias("n")),
        F.struct(op(F.col("line") % 2 == 0).alias("op"), F.col("l_seq").alias("n")),
    )
    return Reads(spark, sf).reads.select(
        "qname", "line", "pos", "price", R.read_length(F.col("l_seq"), cigar).cast("bigint").alias("read_len")
    )


# ---------------------------------------------------------------- histograms


@query("isize_histogram", "SELECT rg, size, cnt FROM rhist", "rhist")
def isize_histogram(spark, sf):
    return Reads(spark, sf).hist


@query(
    "hist_mean_std",
    "SELECT rg, n, round(mean, 6) AS mean, round(stddev, 6) AS stddev FROM rmom",
    "rmom",
)
def hist_mean_std(spark, sf):
    return histograms.moments(Reads(spark, sf).hist).select(
        "rg", "n", F.round("mean", 6).alias("mean"), F.round("stddev", 6).alias("stddev")
    )


@query("hist_lower_median", "SELECT rg, median FROM rmed", "rmed")
def hist_lower_median(spark, sf):
    return histograms.lower_median(Reads(spark, sf).hist)


@query(
    "nearest_rank_percentile",
    "SELECT rg, list_sort(list(size))[CAST(ceil(count(*) * 0.95::DOUBLE) AS BIGINT)] AS pct FROM reads GROUP BY rg",
    "reads",
)
def nearest_rank_percentile(spark, sf):
    return histograms.percentile_of(Reads(spark, sf).reads, "rg", "size", 0.95)


BORDERS = "(SELECT rg, CAST(min(size) - 1 AS BIGINT) AS lo, CAST(max(size) + 2 AS BIGINT) AS hi FROM rhist GROUP BY rg)"


def _dense(b: Reads):
    borders = b.hist.groupBy("rg").agg((F.min("size") - 1).alias("lo"), (F.max("size") + 2).alias("hi"))
    return histograms.dense_histogram(b.hist, borders)


@query(
    "hist_quantile_dist",
    """SELECT r.rg, CAST(abs(min(CASE WHEN upto >= 0.01::DOUBLE * total THEN size END) - max(median)) AS BIGINT) AS lower_q,
       CAST(abs(min(CASE WHEN upto >= 0.99::DOUBLE * total THEN size END) - max(median)) AS BIGINT) AS upper_q
FROM (SELECT *, sum(cnt) OVER (PARTITION BY rg ORDER BY size) AS upto, sum(cnt) OVER (PARTITION BY rg) AS total FROM rhist) r
JOIN rmed m ON r.rg = m.rg GROUP BY r.rg""",
    "rhist", "rmed",
)
def hist_quantile_dist(spark, sf):
    b = Reads(spark, sf)
    dense = _dense(b).join(histograms.lower_median(b.hist), "rg")
    return histograms.quantile_distances(dense).select("rg", "lower_q", "upper_q")


@query(
    "hist_trim_bounds",
    """SELECT d.rg, greatest(1, CAST(floor(median - 3 * stddev) AS BIGINT)) AS lo,
       least(19999, CAST(ceil(median + 3 * stddev) AS BIGINT) + 1) AS hi FROM rmed d JOIN rmom m ON d.rg = m.rg""",
    "rmed", "rmom",
)
def hist_trim_bounds(spark, sf):
    stats = _stats(Reads(spark, sf))
    lo, hi = histograms.trim_borders(F.col("median"), F.col("stddev"), F.lit(20_000))
    return stats.select("rg", lo.alias("lo"), hi.alias("hi"))


@query(
    "hist_trim_fixed_point",
    "SELECT rg, lo, hi, median, round(mean, 6) AS mean, round(stddev, 6) AS stddev FROM trimmed",
    "trimmed",
)
def hist_trim_fixed_point(spark, sf):
    return histograms.trimmed_stats(Reads(spark, sf).hist, 20_000).select(
        "rg", "lo", "hi", "median", F.round("mean", 6).alias("mean"), F.round("stddev", 6).alias("stddev")
    )


KERN = "(SELECT * FROM (VALUES " + ", ".join(
    f"({j - D.SMOOTH_REACH}, {k / D.KERNEL_SUM!r}::DOUBLE)" for j, k in enumerate(D.KERNEL)
) + ") AS t(j, w))"
SMOOTHED = f"""(SELECT s.rg, s.lo, s.hi, s.size, sum(k.w * coalesce(n.cnt, 0)) AS v
  FROM (SELECT rg, lo, hi, CAST(unnest(generate_series(lo, hi - 1)) AS BIGINT) AS size FROM {BORDERS}) s
  CROSS JOIN {KERN} k LEFT JOIN rhist n ON n.rg = s.rg AND n.size = s.size + k.j GROUP BY s.rg, s.lo, s.hi, s.size)"""


@query("hist_smooth", f"SELECT rg, size, round(v, 6) AS v FROM {SMOOTHED}", "rhist")
def hist_smooth(spark, sf):
    dense = _dense(Reads(spark, sf)).withColumn("values", histograms.smoothed("values"))
    return dense.select("rg", "offset", F.posexplode("values").alias("i", "v")).select(
        "rg", (F.col("offset") + F.col("i")).alias("size"), F.round("v", 6).alias("v")
    )


@query(
    "hist_density",
    f"""SELECT rg, size, round(greatest(v, max(v) OVER (PARTITION BY rg) / 500.0::DOUBLE), 10) AS v FROM (
  SELECT rg, size, v / sum(v) OVER (PARTITION BY rg) * CASE WHEN size > lo AND size < hi - 1
         THEN (255 + greatest(1, size - 1 - 2 * 50)) / 256.0::DOUBLE ELSE 1.0 END AS v FROM {SMOOTHED})""",
    "rhist",
)
def hist_density(spark, sf):
    b = Reads(spark, sf)
    dense = _dense(b).join(histograms.lower_median(b.hist), "rg").withColumn("read_len", F.lit(50).cast("bigint"))
    return histograms.densities(dense).select("rg", "offset", F.posexplode("values").alias("i", "v")).select(
        "rg", (F.col("offset") + F.col("i")).alias("size"), F.round("v", 10).alias("v")
    )


@query(
    "rg_coverage",
    """SELECT r.rg, count(*) AS n, round(count(*) / (SELECT CAST(max(pos) AS DOUBLE) FROM reads) * 50 * 2, 6) AS coverage,
       count(*) / (SELECT CAST(max(pos) AS DOUBLE) FROM reads) * 50 * 2 < 1000 AS low
FROM reads r GROUP BY r.rg""",
    "reads",
)
def rg_coverage(spark, sf):
    b = Reads(spark, sf)
    length = b.reads.select(F.max("pos").cast("double")).scalar()
    groups = b.hist.select("rg").distinct().withColumn("read_len", F.lit(50))
    cov = histograms.coverage(b.hist, length, groups)
    return cov.select("rg", "n", F.round("coverage", 6).alias("coverage"), (F.col("coverage") < 1000).alias("low"))


@query(
    "capped_histogram",
    "SELECT rg, least(abs(size - 500), 199) AS size, count(*) AS cnt FROM reads GROUP BY ALL",
    "reads",
)
def capped_histogram(spark, sf):
    rows = Reads(spark, sf).reads.select("rg", histograms.capped_size(F.col("size") - 500, 200).alias("size"))
    return histograms.insert_size_histogram(rows)


@query(
    "low_coverage",
    """SELECT rg, n, round(count_all * 50 * 2, 6) AS coverage FROM (
  SELECT rg, count(*) AS n, count(*) / (SELECT CAST(max(pos) AS DOUBLE) FROM reads) AS count_all FROM reads GROUP BY rg)
WHERE count_all * 50 * 2 < 1500""",
    "reads",
)
def low_coverage(spark, sf):
    b = Reads(spark, sf)
    length = b.reads.select(F.max("pos").cast("double")).scalar()
    cov = histograms.coverage(b.hist, length, b.hist.select("rg").distinct().withColumn("read_len", F.lit(50)))
    return histograms.low_coverage(cov, 1500).select("rg", "n", F.round("coverage", 6).alias("coverage"))


@query(
    "fill_open_intervals",
    """SELECT i.itv, i.contig, CASE WHEN itv % 3 = 0 THEN 0 ELSE beg END AS beg, CASE WHEN itv % 5 = 0 THEN n.len ELSE "end" END AS "end"
FROM itv i JOIN (SELECT contig, max("end") AS len FROM itv GROUP BY contig) n ON i.contig = n.contig""",
    "itv",
)
def fill_open_intervals(spark, sf):
    b = Intervals(spark, sf)
    rows = b.intervals.withColumn("beg", F.when(F.col("itv") % 3 != 0, F.col("beg"))).withColumn(
        "end", F.when(F.col("itv") % 5 != 0, F.col("end"))
    )
    return intervals.close_intervals(rows, b.contigs).select("itv", "contig", "beg", "end")


@query(
    "sampling_stop",
    """SELECT CAST(CASE WHEN count(*) = count(itv) THEN max(itv) END AS BIGINT) AS last_itv FROM (
  SELECT g.rg, min(s.itv) AS itv FROM (SELECT DISTINCT rg FROM reads) g LEFT JOIN (
    SELECT rg, itv, sum(cnt) OVER (PARTITION BY rg ORDER BY itv) AS upto FROM (
      SELECT rg, pos // 20 AS itv, count(*) AS cnt FROM reads GROUP BY rg, pos // 20)) s
  ON g.rg = s.rg AND s.upto >= 500 GROUP BY g.rg)""",
    "reads",
)
def sampling_stop(spark, sf):
    rows = Reads(spark, sf).reads.select("rg", F.floor(F.col("pos") / 20).alias("itv"))
    counts = rows.groupBy("rg", "itv").agg(F.count(F.lit(1)).alias("cnt"))
    return histograms.sampling_stop(counts, counts, 500)


@query(
    "rg_thresholds",
    """SELECT t.rg, t.min_init_len, CAST(list_sort(a.l)[CAST(ceil(len(a.l) * 0.95::DOUBLE) AS BIGINT)] AS BIGINT) AS min_len,
       round(a.mean_stddev, 6) AS mean_stddev
FROM (SELECT rg, CAST(floor(4 * stddev + 0.5) AS BIGINT) AS min_init_len FROM rmom) t
CROSS JOIN (SELECT list(CAST(floor(4 * stddev + 0.5) AS BIGINT)) AS l, avg(stddev) AS mean_stddev FROM rmom) a""",
    "rmom",
)
def rg_thresholds(spark, sf):
    stats = histograms.moments(Reads(spark, sf).hist)
    groups = histograms.initial_thresholds(stats, None)
    scalars = histograms.cohort_scalars(groups)
    # One row of scalars next to one row per read group.
    return groups.select(
        "rg", "min_init_len",
        scalars.select("min_len").scalar().alias("min_len"),
        F.round(scalars.select("mean_stddev").scalar(), 6).alias("mean_stddev"),
    )


@query(
    "max_insert_sizes",
    "SELECT d.rg, CAST(floor(median + 2 * stddev + 10000) AS BIGINT) AS max_insert FROM rmed d JOIN rmom m ON d.rg = m.rg",
    "rmed", "rmom",
)
def max_insert_sizes(spark, sf):
    return reads.max_insert_sizes(_stats(Reads(spark, sf)), 10_000).select("rg", "max_insert")


# ---------------------------------------------------------------- intervals

REGION_TEXT = """CASE o_orderkey % 7 WHEN 0 THEN o_orderpriority WHEN 1 THEN 'chr' || (o_orderkey % 22) || ':' || o_custkey
  WHEN 2 THEN 'chr' || (o_orderkey % 22) || ':' || o_custkey || '-' || (o_custkey + o_orderkey)
  WHEN 3 THEN 'HLA-A*01:' || o_custkey WHEN 4 THEN 'chr1:' WHEN 5 THEN 'a:b:' || o_custkey || '-' || (o_custkey + 9)
  ELSE 'chr1:' || o_custkey || 'x' END"""


@query(
    "region_parse",
    f"""SELECT o_orderkey, region, contig, beg, "end",
       CASE WHEN contig IS NOT NULL THEN contig || CASE WHEN beg IS NULL THEN '' ELSE ':' || (beg + 1) || CASE WHEN "end" IS NULL THEN '' ELSE '-' || "end" END END END AS shown
FROM (SELECT o_orderkey, region,
  CASE WHEN kind IN (4, 6) OR (kind IN (1, 2, 3, 5) AND o_custkey < 1) THEN NULL
       WHEN kind = 0 THEN region WHEN kind = 5 THEN 'a:b' ELSE split_part(region, ':', 1) END AS contig,
  CASE WHEN kind IN (1, 2, 3, 5) AND o_custkey >= 1 THEN o_custkey - 1 END AS beg,
  CASE WHEN o_custkey < 1 THEN NULL WHEN kind = 2 THEN o_custkey + o_orderkey WHEN kind = 5 THEN o_custkey + 9 END AS "end"
  FROM (SELECT o_orderkey, o_custkey, o_orderkey % 7 AS kind, {REGION_TEXT} AS region FROM orders))""",
)
def region_parse(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    rows = orders.select("o_orderkey", F.expr(REGION_TEXT).alias("region"))
    parsed = rows.withColumn("r", regions.parse_region(F.col("region"))).select("o_orderkey", "region", "r.*")
    return parsed.withColumn("shown", regions.format_region(F.col("contig"), F.col("beg"), F.col("end")))


@query(
    "merge_intervals",
    """SELECT contig, min(beg) AS beg, max("end") AS "end", count(*) AS n_merged FROM (
  SELECT *, sum(opens) OVER (PARTITION BY contig ORDER BY beg, "end", itv) AS island FROM (
    SELECT *, CASE WHEN beg <= max("end") OVER (PARTITION BY contig ORDER BY beg, "end", itv ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 5
              THEN 0 ELSE 1 END AS opens FROM itv)) GROUP BY contig, island""",
    "itv",
)
def merge_intervals(spark, sf):
    return intervals.merge_intervals(Intervals(spark, sf).intervals, max_gap=5, tile=5_000)


@query(
    "contig_semi_anti",
    """SELECT p_brand AS contig, count(*) AS n,
       p_brand IN (SELECT p_brand FROM part WHERE p_size = 1 AND p_type = 'ECONOMY') AS known
FROM part GROUP BY p_brand""",
)
def contig_semi_anti(spark, sf):
    parts = spark.read.parquet(f"{sf}/part.parquet")
    rows = parts.select(F.col("p_brand").alias("contig"))
    contigs = parts.where("p_size = 1 AND p_type = 'ECONOMY'").select(F.col("p_brand").alias("contig"))
    kept = intervals.on_contigs(rows, contigs).withColumn("known", F.lit(True))
    unknown = intervals.unknown_contigs(rows, contigs).withColumn("known", F.lit(False))
    return kept.unionByName(unknown).groupBy("contig").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or("known").alias("known")
    )


@query(
    "roi_order",
    """SELECT i.itv, i.contig, n.contig_id, i.beg, least(i."end", n.len) AS "end" FROM itv i JOIN (
  SELECT contig, len, CAST(row_number() OVER (ORDER BY contig DESC) - 1 AS BIGINT) AS contig_id FROM (
    SELECT contig, max("end") AS len FROM itv GROUP BY contig)) n ON i.contig = n.contig""",
    "itv",
)
def roi_order(spark, sf):
    from pyspark.sql import Window

    b = Intervals(spark, sf)
    # One row per contig.
    rank = (F.row_number().over(Window.orderBy(F.desc("contig"))) - 1).cast("bigint")
    contigs = b.contigs.withColumn("contig_id", rank)
    closed = intervals.close_intervals(b.intervals, b.contigs)
    return intervals.in_contig_order(closed, contigs).select("itv", "contig", "contig_id", "beg", "end")


@query(
    "whole_contig_intervals",
    """SELECT contig, 0::BIGINT AS beg, max("end") AS "end", CAST(max("end") // 10000 + 1 AS BIGINT) AS n_regions FROM itv GROUP BY contig""",
    "itv",
)
def whole_contig_intervals(spark, sf):
    contigs = Intervals(spark, sf).contigs
    return intervals.whole_contigs(contigs).join(intervals.index_regions(contigs, 10_000), "contig")


@query(
    "expand_intervals",
    """SELECT itv, contig, greatest(0, beg - 50000) AS beg, "end" + 50000 AS "end" FROM itv""",
    "itv",
)
def expand_intervals(spark, sf):
    return intervals.expand(Intervals(spark, sf).intervals, 50_000)


@query(
    "distinct_files",
    """SELECT url AS file, count(*) AS n, regexp_replace(regexp_replace(url, '^.+[/\\\\]', ''), '\\.[^.]*$', '') AS sample
FROM pages GROUP BY url""",
)
def distinct_files(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select(F.col("url").alias("file"))
    return pages.groupBy("file").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "sample", regions.sample_name(F.col("file"))
    )
