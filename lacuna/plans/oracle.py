"""Reference SQL of the checkable queries, assembled from named common table expressions."""

from __future__ import annotations

import math
import re

from lacuna.functions.density import KERNEL, KERNEL_SUM, SMOOTH_REACH
from lacuna.functions.genotype import likelihood_ladder

EPS = "1e-10"
LN2 = repr(math.log(2.0))

#: Names whose body reads itself.
RECURSIVE = {"trim", "admission"}

# name -> (names it reads, body)
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, body: str, *needs: str) -> None:
    CTES[name] = (needs, body)


def with_ctes(select: str, *names: str) -> str:
    """Puts the named expressions and everything they read in front of a query."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for need in CTES[name][0]:
            visit(need)
        ordered.append(name)

    for name in names:
        visit(name)
    if not ordered:
        return select
    parts = ",\n".join(f"{n} AS ({CTES[n][1]})" for n in ordered)
    recursive = " RECURSIVE" if any(n in RECURSIVE for n in ordered) else ""
    return f"WITH{recursive} {parts}\n{select}"


cte(
    "b1",
    """SELECT event_type AS contig, user_id % 5 AS sample, user_id % 10 AS rg,
       CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 1440 + hour(ts) * 60 + minute(ts) AS BIGINT) AS start,
       200 + CAST(floor(value) AS BIGINT) AS isize
FROM events""",
)
cte("hist", "SELECT rg, isize AS size, count(*) AS cnt FROM b1 GROUP BY rg, isize", "b1")
cte(
    "med",
    """SELECT rg, CAST(min(size) AS BIGINT) AS median FROM (
  SELECT rg, size, sum(cnt) OVER (PARTITION BY rg ORDER BY size) AS upto, sum(cnt) OVER (PARTITION BY rg) AS total
  FROM hist) WHERE upto * 2 >= total GROUP BY rg""",
    "hist",
)
cte(
    "mom",
    """SELECT h.rg, max(m.n) AS n, max(m.mean) AS mean,
       sqrt(sum(h.cnt * (h.size - m.mean) * (h.size - m.mean)) / (max(m.n) - 1)) AS stddev
FROM hist h JOIN (SELECT rg, CAST(sum(cnt) AS BIGINT) AS n, CAST(sum(size * cnt) AS DOUBLE) / CAST(sum(cnt) AS DOUBLE) AS mean
                  FROM hist GROUP BY rg) m ON h.rg = m.rg GROUP BY h.rg""",
    "hist",
)
cte(
    "pairs",
    """SELECT *, CAST(end_pos // 30 * 30 AS BIGINT) AS last_win FROM (
  SELECT b.contig, b.sample, b.rg, b.start, b.isize, b.isize - m.median AS dev,
         b.start + greatest(0, b.isize - 100) AS end_pos
  FROM b1 b JOIN med m ON b.rg = m.rg)""",
    "b1", "med",
)
cte(
    "active",
    """SELECT contig, sample, rg, start, dev, end_pos,
       CAST(unnest(generate_series((start + 29) // 30 * 30, last_win + 30, 30)) AS BIGINT) AS p FROM pairs""",
    "pairs",
)
cte(
    "loads",
    """SELECT contig, p, sample, rg, count(*) AS n, min(start) AS first_pos, max(end_pos) AS last_pos
FROM active GROUP BY contig, p, sample, rg""",
    "active",
)
cte(
    "usable",
    """SELECT a.* FROM active a JOIN loads l
  ON a.contig = l.contig AND a.p = l.p AND a.rg = l.rg WHERE l.n < 100""",
    "active", "loads",
)
cte(
    "sampled",
    "SELECT contig, p, sample, CAST(sum(n) AS BIGINT) AS n_active FROM loads GROUP BY contig, p, sample",
    "loads",
)
# Third quartile per grid point and sample, from sorted lists.
cte(
    "q3",
    """SELECT contig, p, sample, n,
       CASE WHEN n < 4 THEN devs[n]
            ELSE CAST(floor((1 - (pos - l)) * devs[l + 1] + (pos - l) * devs[l + 2] + 0.5) AS BIGINT) END AS q3
FROM (SELECT *, CAST(floor(pos) AS BIGINT) AS l FROM (
  SELECT u.contig, u.p, u.sample, count(*) AS n, list_sort(list(u.dev)) AS devs,
         (3.0::DOUBLE * count(*) + 2.0 + count(*) % 2) / 4.0 - 1.0 AS pos
  FROM usable u JOIN sampled s ON u.contig = s.contig AND u.p = s.p AND u.sample = s.sample
  WHERE s.n_active >= 2 GROUP BY u.contig, u.p, u.sample))""",
    "usable", "sampled",
)
cte(
    "cand",
    """SELECT contig, p, CAST(total // n AS BIGINT) AS len0 FROM (
  SELECT contig, p, chain, CAST(sum(q3) AS BIGINT) AS total, count(*) AS n FROM (
    SELECT *, sum(opens) OVER (PARTITION BY contig, p ORDER BY q3, sample) AS chain FROM (
      SELECT *, CASE WHEN q3 - lag(q3) OVER (PARTITION BY contig, p ORDER BY q3, sample) < 50 THEN 0 ELSE 1 END AS opens
      FROM q3)) GROUP BY contig, p, chain) WHERE total // n > 20""",
    "q3",
)
# Smoothed, scaled, window-corrected and floored density per read group.
cte(
    "borders",
    "SELECT rg, CAST(min(size) - 1 AS BIGINT) AS lo, CAST(max(size) + 2 AS BIGINT) AS hi FROM hist GROUP BY rg",
    "hist",
)
cte(
    "spine",
    """SELECT b.rg, b.lo, b.hi, s.size, CAST(coalesce(h.cnt, 0) AS DOUBLE) AS cnt
FROM (SELECT rg, lo, hi, CAST(unnest(generate_series(lo, hi - 1)) AS BIGINT) AS size FROM borders) s
JOIN borders b ON s.rg = b.rg LEFT JOIN hist h ON h.rg = s.rg AND h.size = s.size""",
    "borders", "hist",
)
cte(
    "kern",
    "SELECT * FROM (VALUES "
    + ", ".join(f"({j - SMOOTH_REACH}, {k / KERNEL_SUM!r}::DOUBLE)" for j, k in enumerate(KERNEL))
    + ") AS t(j, w)",
)
cte(
    "smoothed",
    """SELECT s.rg, s.lo, s.hi, s.size, sum(k.w * coalesce(n.cnt, 0)) AS v
FROM spine s CROSS JOIN kern k LEFT JOIN hist n ON n.rg = s.rg AND n.size = s.size + k.j
GROUP BY s.rg, s.lo, s.hi, s.size""",
    "spine", "kern", "hist",
)
cte(
    "scaled",
    """SELECT rg, lo, hi, size,
       v / total * CASE WHEN size > lo AND size < hi - 1
                        THEN (255 + greatest(1, size - 101)) / 256.0::DOUBLE ELSE 1.0 END AS v
FROM (SELECT *, sum(v) OVER (PARTITION BY rg) AS total FROM smoothed)""",
    "smoothed",
)
cte(
    "minp",
    "SELECT rg, lo, hi, max(v) / 500.0::DOUBLE AS min_prob FROM scaled GROUP BY rg, lo, hi",
    "scaled",
)
cte(
    "dens",
    """SELECT s.rg, s.size, greatest(s.v, m.min_prob) AS v FROM scaled s JOIN minp m ON s.rg = m.rg
WHERE s.size > s.lo AND s.size < s.hi - 1""",
    "scaled", "minp",
)
cte(
    "quant",
    """SELECT r.rg, abs(min(CASE WHEN r.upto >= 0.01 * r.total THEN r.size END) - max(m.median)) AS lower_q,
       abs(min(CASE WHEN r.upto >= 0.99 * r.total THEN r.size END) - max(m.median)) AS upper_q
FROM (SELECT *, sum(v) OVER (PARTITION BY rg ORDER BY size) AS upto, sum(v) OVER (PARTITION BY rg) AS total
      FROM smoothed WHERE size > lo AND size < hi - 1) r JOIN med m ON r.rg = m.rg GROUP BY r.rg""",
    "smoothed", "med",
)
cte(
    "obs",
    "SELECT contig, p, sample, rg, dev, count(*) AS cnt FROM usable GROUP BY contig, p, sample, rg, dev",
    "usable",
)
cte(
    "seed",
    """SELECT contig, p, len0, inside / total AS af FROM (
  SELECT o.contig, o.p, c.len0, CAST(sum(o.cnt) AS DOUBLE) AS total,
         CAST(sum(CASE WHEN o.dev > greatest(c.len0 // 2, CAST(floor(c.len0 - 2 * m.stddev + 0.5) AS BIGINT))
                        AND o.dev < CAST(floor(c.len0 + 2 * m.stddev) AS BIGINT) THEN o.cnt ELSE 0 END) AS DOUBLE) AS inside
  FROM obs o JOIN cand c ON o.contig = c.contig AND o.p = c.p JOIN mom m ON o.rg = m.rg
  GROUP BY o.contig, o.p, c.len0)""",
    "obs", "cand", "mom",
)
cte(
    "state",
    f"""SELECT *, greatest((1 - af) * (1 - af), {EPS}) AS g0, greatest(2 * af * (1 - af), {EPS}) AS g1,
       greatest(af * af, {EPS}) AS g2 FROM seed WHERE af > 0""",
    "seed",
)
cte(
    "pd",
    """SELECT o.contig, o.p, s.len0, o.sample, o.rg, o.dev, o.cnt,
       coalesce(r.v, m.min_prob) AS ref, coalesce(d.v, m.min_prob) AS dl
FROM obs o JOIN state s ON o.contig = s.contig AND o.p = s.p
JOIN minp m ON m.rg = o.rg JOIN med ON med.rg = o.rg
LEFT JOIN dens r ON r.rg = o.rg AND r.size = o.dev + med.median
LEFT JOIN dens d ON d.rg = o.rg AND d.size = o.dev + med.median - s.len0""",
    "obs", "state", "minp", "med", "dens",
)
cte(
    "logs",
    f"""SELECT contig, p, len0, sample, sum(cnt * ln(ref)) AS l0, sum(cnt * (ln(ref + dl) - {LN2})) AS l1,
       sum(cnt * ln(dl)) AS l2 FROM pd GROUP BY contig, p, len0, sample""",
    "pd",
)
cte(
    "lik",
    f"""SELECT contig, p, len0, sample, l0, l1, l2,
       CASE WHEN bad THEN 1.0 ELSE r0 END AS d0, CASE WHEN bad THEN {EPS} ELSE r1 END AS d1,
       CASE WHEN bad THEN {EPS} ELSE r2 END AS d2
FROM (SELECT *, (least(r0, r1, r2) = 0 OR least(r0, r1, r2) > 1 - 1e-9) AS bad FROM (
  SELECT *, exp(l0 - greatest(l0, l1, l2)) AS r0, exp(l1 - greatest(l0, l1, l2)) AS r1,
         exp(l2 - greatest(l0, l1, l2)) AS r2 FROM logs))""",
    "logs",
)
cte(
    "post",
    """SELECT l.*, s.g0, s.g1, s.g2, l.d0 * s.g0 AS p0, l.d1 * s.g1 AS p1, l.d2 * s.g2 AS p2
FROM lik l JOIN state s ON l.contig = s.contig AND l.p = s.p AND l.len0 = s.len0""",
    "lik", "state",
)
cte(
    "afup",
    f"""SELECT contig, p, len0, (sum((p1 + 2 * p2) / (p0 + p1 + p2))
       + (5 - count(*)) * ({EPS} * max(g1) + 2 * {EPS} * max(g2)) / (max(g0) + {EPS} * max(g1) + {EPS} * max(g2))) / 2.0 / 5 AS af
FROM post GROUP BY contig, p, len0""",
    "post",
)
cte(
    "lrs",
    f"""SELECT contig, p, len0, sum(ln((p0 * d0 + p1 * d1 + p2 * d2) / (p0 + p1 + p2)) - ln(d0))
       + (5 - count(*)) * ln((max(g0) + ({EPS} * max(g1) + {EPS} * max(g2)) * {EPS})
                             / (max(g0) + {EPS} * max(g1) + {EPS} * max(g2))) AS lr
FROM post GROUP BY contig, p, len0""",
    "post",
)
cte(
    "lad",
    """SELECT contig, p, len0, sample,
       CAST(sum(CASE WHEN ref >= 2 * dl THEN cnt ELSE 0 END) AS BIGINT) AS lad_ref,
       CAST(sum(CASE WHEN ref < 2 * dl AND dl < 2 * ref THEN cnt ELSE 0 END) AS BIGINT) AS lad_amb,
       CAST(sum(CASE WHEN ref < 2 * dl AND dl >= 2 * ref THEN cnt ELSE 0 END) AS BIGINT) AS lad_del
FROM pd GROUP BY contig, p, len0, sample""",
    "pd",
)
cte(
    "dad",
    """SELECT contig, p, len0, sample,
       CAST(sum(CASE WHEN dev <= upper_q AND dev < len0 - lower_q THEN cnt ELSE 0 END) AS BIGINT) AS dad_ref,
       CAST(sum(CASE WHEN dev <= upper_q AND dev >= len0 - lower_q THEN cnt ELSE 0 END) AS BIGINT) AS dad_both,
       CAST(sum(CASE WHEN dev > upper_q AND dev < len0 - lower_q THEN cnt ELSE 0 END) AS BIGINT) AS dad_between,
       CAST(sum(CASE WHEN dev > upper_q AND dev >= len0 - lower_q AND dev <= len0 + upper_q THEN cnt ELSE 0 END) AS BIGINT) AS dad_alt,
       CAST(sum(CASE WHEN dev > upper_q AND dev >= len0 - lower_q AND dev > len0 + upper_q THEN cnt ELSE 0 END) AS BIGINT) AS dad_right
FROM (SELECT o.*, s.len0, q.lower_q, q.upper_q FROM obs o JOIN state s ON o.contig = s.contig AND o.p = s.p
      JOIN quant q ON q.rg = o.rg) GROUP BY contig, p, len0, sample""",
    "obs", "state", "quant",
)
cte(
    "pls",
    """SELECT contig, p, len0, sample,
       CASE WHEN nodata THEN 0 WHEN flat THEN 0 ELSE CAST(round(10 * (best - l0) / ln(10.0)) AS BIGINT) END AS pl0,
       CASE WHEN nodata THEN 0 WHEN flat THEN 100 ELSE CAST(round(10 * (best - l1) / ln(10.0)) AS BIGINT) END AS pl1,
       CASE WHEN nodata THEN 0 WHEN flat THEN 100 ELSE CAST(round(10 * (best - l2) / ln(10.0)) AS BIGINT) END AS pl2
FROM (SELECT l.*, greatest(l0, l1, l2) AS best,
             (greatest(l0, l1, l2) - least(l0, l1, l2)) / ln(10.0) < 1e-9 AS flat, s.n_active < 2 AS nodata
      FROM logs l JOIN sampled s ON l.contig = s.contig AND l.p = s.p AND l.sample = s.sample)""",
    "logs", "sampled",
)
cte(
    "gts",
    """SELECT *, CASE WHEN pl0 + pl1 + pl2 = 0 THEN 0 ELSE least(255,
         CASE WHEN pl0 = 0 THEN least(pl1, pl2) WHEN pl1 = 0 THEN least(pl0, pl2) ELSE least(pl0, pl1) END) END AS gq
FROM pls""",
    "pls",
)
LENGTH_STEP = """SELECT contig, p, len0, CAST(CASE WHEN weight = 0 OR moment / weight < 0 THEN 0 ELSE floor(moment / weight + 0.5) END AS BIGINT) AS len
FROM (SELECT d.contig, d.p, d.len0, sum(w) AS weight, sum(w * d.dev) AS moment FROM (
  SELECT pd.*, pd.cnt * (p1 / (p0 + p1 + p2) * pd.dl / (pd.dl + pd.ref) + p2 / (p0 + p1 + p2)) AS w
  FROM pd JOIN post t ON pd.contig = t.contig AND pd.p = t.p AND pd.len0 = t.len0 AND pd.sample = t.sample) d
GROUP BY d.contig, d.p, d.len0)"""
SHIFT_STEP = f"""SELECT contig, p, len0, rg, CAST(CASE WHEN weight > 0 AND abs(trunc(mean)) <= stddev THEN trunc(mean) ELSE 0 END AS BIGINT) AS shift
FROM (SELECT *, moment / weight + sign(moment / weight) * 1e-9::DOUBLE AS mean FROM (
      SELECT d.contig, d.p, d.len0, d.rg, max(m.stddev) AS stddev, sum(w) AS weight, sum(w * dev) AS moment
      FROM (SELECT pd.*, pd.cnt * (b1 * pd.ref / (pd.dl + pd.ref) + b0) AS w FROM pd JOIN (
              SELECT contig, p, len0, rg, r0 * g0 / (r0 * g0 + r1 * g1 + r2 * g2) AS b0, r1 * g1 / (r0 * g0 + r1 * g1 + r2 * g2) AS b1
              FROM (SELECT l.*, s.g0, s.g1, s.g2, exp(l0 - greatest(l0, l1, l2)) AS r0, exp(l1 - greatest(l0, l1, l2)) AS r1,
                           exp(l2 - greatest(l0, l1, l2)) AS r2
                    FROM (SELECT contig, p, len0, rg, sum(cnt * ln(ref)) AS l0, sum(cnt * (ln(ref + dl) - {LN2})) AS l1,
                                 sum(cnt * ln(dl)) AS l2 FROM pd GROUP BY contig, p, len0, rg) l
                    JOIN state s ON l.contig = s.contig AND l.p = s.p AND l.len0 = s.len0)) t
            ON pd.contig = t.contig AND pd.p = t.p AND pd.len0 = t.len0 AND pd.rg = t.rg) d
      JOIN mom m ON m.rg = d.rg GROUP BY d.contig, d.p, d.len0, d.rg))"""
_DENSITIES = """SELECT o.contig, o.p, s.len0, o.sample, o.rg, o.dev, o.cnt,
       coalesce(r.v, m.min_prob) AS ref, coalesce(d.v, m.min_prob) AS dl
FROM obs o JOIN state s ON o.contig = s.contig AND o.p = s.p
JOIN minp m ON m.rg = o.rg JOIN med ON med.rg = o.rg
LEFT JOIN shifts h ON h.contig = o.contig AND h.p = o.p AND h.len0 = s.len0 AND h.rg = o.rg
LEFT JOIN dens r ON r.rg = o.rg AND r.size = o.dev + med.median - coalesce(h.shift, 0)
LEFT JOIN dens d ON d.rg = o.rg AND d.size = o.dev + med.median - s.len"""
_SAME = "a.contig = {0}.contig AND a.p = {0}.p AND a.len0 = {0}.len0"


def unrolled_estimation(rounds: int, min_len: int, min_lr: float) -> str:
    """Defines the given number of estimation rounds, each a chain of expressions; returns the last one's name.

    The bodies are those of the single step with the names of the round in place.
    """
    base = ("obs", "minp", "med", "dens", "mom")

    def define(name: str, body: str, **names: str) -> str:
        for old, new in names.items():
            # an alias is in small letters; a name without one becomes the alias
            body = re.sub(rf"\b(FROM|JOIN) {old}\b(?! [a-z])", rf"\1 {new} {old}", body)
            body = re.sub(rf"\b(FROM|JOIN) {old} (?=[a-z])", rf"\1 {new} ", body)
        cte(name, body, *names.values(), *base)
        return name

    def likelihoods(tag: str, states: str, shifts: str) -> tuple[str, str]:
        pd = define(f"pd{tag}", _DENSITIES, state=states, shifts=shifts)
        logs = define(f"logs{tag}", CTES["logs"][1], pd=pd)
        return pd, define(f"lik{tag}", CTES["lik"][1], logs=logs)

    def ratio(tag: str, lik: str, weights: str) -> tuple[str, str]:
        post = define(f"post{tag}", CTES["post"][1], lik=lik, state=weights)
        return post, define(f"lrs{tag}", CTES["lrs"][1], post=post)

    past = [f"CAST(NULL AS BIGINT) AS vl{k}, CAST(NULL AS DOUBLE) AS va{k}" for k in range(rounds)]
    cte(f"st_{rounds}00", f"SELECT *, len0 AS len, 0 AS iterations, TRUE AS alive, {', '.join(past)} FROM state", "state")
    state = f"st_{rounds}00"
    cte(f"sh_{rounds}00", "SELECT contig, p, len0, CAST(0 AS BIGINT) AS rg, CAST(0 AS BIGINT) AS shift FROM state WHERE FALSE", "state")
    shifts = f"sh_{rounds}00"
    for t in range(rounds):
        n = f"_{rounds}{t}1"
        active = define(f"act{n}", f"SELECT * FROM s WHERE alive AND len >= {min_len}", s=state)
        pd, lik = likelihoods(f"b{n}", active, shifts)
        post, before = ratio(f"b{n}", lik, active)
        longer = define(f"nl{n}", LENGTH_STEP, pd=pd, post=post)
        moved_shift = define(f"ns{n}", SHIFT_STEP, pd=pd, state=active)
        cte(f"mv{n}", f"SELECT a.* EXCLUDE (len), b.len FROM {active} a JOIN {longer} b ON {_SAME.format('b')}", active, longer)
        _, lik = likelihoods(f"a{n}", f"mv{n}", moved_shift)
        post, _ = ratio(f"a{n}", lik, active)
        share = define(f"af{n}", CTES["afup"][1], post=post)
        weights = define(
            f"wt{n}",
            f"""SELECT *, greatest((1 - af) * (1 - af), {EPS}) AS g0, greatest(2 * af * (1 - af), {EPS}) AS g1,
       greatest(af * af, {EPS}) AS g2 FROM s""",
            s=share,
        )
        _, after = ratio(f"c{n}", lik, weights)
        seen = ", ".join(f"vl{k}" if k != t else "len AS vl" + str(k) for k in range(rounds))
        seen_af = ", ".join(f"va{k}" if k != t else "af AS va" + str(k) for k in range(rounds))
        known = " ".join(f"WHEN n_len = {'len' if k == t else f'vl{k}'} THEN {'af' if k == t else f'va{k}'}" for k in range(t, -1, -1))
        cte(
            f"step{n}",
            f"""SELECT *, settled AND lr_before > lr_now AS back FROM (
  SELECT *, n_af = 0 AS lost, coalesce(n_af <> 0 AND abs(CASE {known} END - n_af) <= 1e-4, FALSE) AS settled FROM (
    SELECT a.*, b.len AS n_len, c.af AS n_af, c.g0 AS n0, c.g1 AS n1, c.g2 AS n2, d.lr AS lr_before, e.lr AS lr_now
    FROM {active} a JOIN {longer} b ON {_SAME.format('b')} JOIN {weights} c ON {_SAME.format('c')}
    JOIN {before} d ON {_SAME.format('d')} JOIN {after} e ON {_SAME.format('e')}))""",
            active, longer, weights, before, after,
        )
        columns = f"contig, p, len0, len, af, g0, g1, g2, iterations, alive, {', '.join(f'vl{k}, va{k}' for k in range(rounds))}"
        cte(
            f"st{n}",
            f"""SELECT {columns} FROM (
  SELECT contig, p, len0, CASE WHEN back THEN len ELSE n_len END AS len, CASE WHEN back THEN af ELSE n_af END AS af,
         CASE WHEN lost THEN g0 ELSE n0 END AS g0, CASE WHEN lost THEN g1 ELSE n1 END AS g1, CASE WHEN lost THEN g2 ELSE n2 END AS g2,
         iterations + 1 AS iterations, NOT (settled OR lost) AS alive, {seen}, {seen_af} FROM step{n})
UNION ALL SELECT {columns.replace('alive', 'FALSE')} FROM {state} a WHERE NOT EXISTS (SELECT 1 FROM step{n} b WHERE {_SAME.format('b')})""",
            f"step{n}", state,
        )
        cte(
            f"sh{n}",
            f"""SELECT a.* FROM {moved_shift} a JOIN step{n} b ON {_SAME.format('b')} WHERE NOT back
UNION ALL SELECT a.* FROM {shifts} a WHERE NOT EXISTS (SELECT 1 FROM step{n} b WHERE {_SAME.format('b')} AND NOT back)""",
            moved_shift, shifts, f"step{n}",
        )
        state, shifts = f"st{n}", f"sh{n}"
    n = f"_{rounds}99"
    good = define(f"good{n}", f"SELECT * FROM s WHERE af >= {EPS} AND len >= {min_len}", s=state)
    _, lik = likelihoods(f"f{n}", good, shifts)
    _, last = ratio(f"f{n}", lik, good)
    cte(
        f"est{n}",
        f"""SELECT a.contig, a.p, a.len0, CAST(a.iterations AS BIGINT) AS iterations, a.len, b.lr, a.af, c.data_samples
FROM {good} a JOIN {last} b ON {_SAME.format('b')}
JOIN (SELECT contig, p, count(*) FILTER (WHERE n_active >= 2) AS data_samples FROM sampled GROUP BY contig, p) c
  ON a.contig = c.contig AND a.p = c.p
WHERE b.lr >= {min_lr}""",
        good, last, "sampled",
    )
    cte(f"em{n}", f"SELECT * REPLACE (round(lr, 4) AS lr, round(af, 4) AS af) FROM est{n}", f"est{n}")
    define(f"pls{n}", CTES["pls"][1], logs=f"logsf{n}", sampled="sampled")
    define(f"lad{n}", CTES["lad"][1], pd=f"pdf{n}")
    define(f"dad{n}", CTES["dad"][1].replace("s.len0", "s.len0, s.len AS size").replace("len0 - lower_q", "size - lower_q")
           .replace("len0 + upper_q", "size + upper_q"), state=f"est{n}", obs="obs", quant="quant")
    return f"em{n}"


# Window calls made up from candidates.
FIRST_POINTS = "(SELECT contig, min(start // 30 * 30) AS first_p FROM b1 GROUP BY contig)"
cte(
    "wcalls",
    f"""SELECT c.contig, CAST((c.p - f.first_p) // 10000 AS BIGINT) AS segment, c.p, c.len0, c.p - 1 AS win_pos,
       c.p + c.len0 % 7 * 5 AS pos, c.p + c.len0 * (c.p // 30 % 3) // 2 AS end_pos, c.len0 AS len,
       CAST(c.len0 % 11 AS DOUBLE) AS lr, CASE WHEN c.p // 30 % 4 = 0 THEN 4 ELSE 0 END AS filter
FROM cand c JOIN {FIRST_POINTS} f ON c.contig = f.contig""",
    "cand", "b1",
)
COUNTS = ("lad_ref", "lad_amb", "lad_del", "dad_ref", "dad_both", "dad_between", "dad_alt", "dad_right")
_SAMPLE_OF = "{0}.contig = g.contig AND {0}.p = g.p AND {0}.len0 = g.len0 AND {0}.sample = g.sample"
_CALL_OF = "{0}.contig = m.contig AND {0}.segment = m.segment AND {0}.cluster = m.cluster"


def samples_of(tag: str, calls: str) -> str:
    """Scores, depths and borders per candidate of ``calls`` and sample with pairs; returns the name."""
    counts = ", ".join(f"coalesce({'l' if c.startswith('lad') else 'd'}.{c}, 0) AS {c}" for c in COUNTS)
    cte(
        f"gen{tag}",
        f"""SELECT g.*, coalesce(s.pl0, 0) AS pl0, coalesce(s.pl1, 0) AS pl1, coalesce(s.pl2, 0) AS pl2, {counts}, f.first, f.last
FROM (SELECT c.contig, c.p, c.len0, n.sample FROM {calls} c JOIN sampled n ON c.contig = n.contig AND c.p = n.p) g
LEFT JOIN pls{tag} s ON {_SAMPLE_OF.format('s')} LEFT JOIN lad{tag} l ON {_SAMPLE_OF.format('l')}
LEFT JOIN dad{tag} d ON {_SAMPLE_OF.format('d')}
LEFT JOIN (SELECT contig, p, sample, min(start) AS first, max(end_pos) AS last FROM usable GROUP BY contig, p, sample) f
  ON f.contig = g.contig AND f.p = g.p AND f.sample = g.sample""",
        calls, "sampled", f"pls{tag}", f"lad{tag}", f"dad{tag}", "usable",
    )
    return f"gen{tag}"


def merging(tag: str, calls: str, samples: str, sigma: int, cover: float, keep_failed: bool) -> None:
    """Clusters, merged positions, genotyping members, merged genotypes and finished calls of window calls.

    The rows of a segment are walked one by one.
    """
    opens = "i" if keep_failed else "CASE WHEN filter = 0 THEN i END"
    cte(
        f"ranked{tag}",
        f"""SELECT *, row_number() OVER (PARTITION BY contig, segment ORDER BY pos, len, lr DESC, win_pos, len0) AS i
FROM {calls}""",
        calls,
    )
    RECURSIVE.add(f"walk{tag}")
    cte(
        f"walk{tag}",
        f"""SELECT r.contig, r.segment, r.i, CAST(0 AS BIGINT) AS cluster, r.pos AS h_pos, r.end_pos AS h_end, r.len AS h_len
FROM ranked{tag} r JOIN (SELECT contig, segment, min({opens}) AS i FROM ranked{tag} GROUP BY contig, segment) b
  ON r.contig = b.contig AND r.segment = b.segment AND r.i = b.i
UNION ALL
SELECT contig, segment, i, CASE WHEN alike AND (laps OR runs) THEN cluster ELSE cluster + 1 END,
       CASE WHEN alike AND (laps OR runs) THEN h_pos ELSE pos END,
       CASE WHEN alike AND laps THEN h_end ELSE end_pos END,
       CASE WHEN alike AND (laps OR runs) THEN h_len ELSE len END
FROM (SELECT *, small + {2 * sigma} >= large OR small >= 0.5 * large AS alike, lap >= 0.25 * short OR lap + {2 * sigma} >= short AS laps,
             (h_span < h_len OR span < len) AND pos - h_pos < small + {4 * sigma} AS runs
      FROM (SELECT *, least(h_pos + h_span, pos + span) - greatest(h_pos, pos) AS lap, least(h_span, span) AS short
            FROM (SELECT r.contig, r.segment, r.i, r.pos, r.end_pos, r.len, w.cluster, w.h_pos, w.h_end, w.h_len,
                         greatest(0, w.h_end - w.h_pos) AS h_span, greatest(0, r.end_pos - r.pos) AS span,
                         least(w.h_len, r.len) AS small, greatest(w.h_len, r.len) AS large
                  FROM walk{tag} w JOIN ranked{tag} r ON r.contig = w.contig AND r.segment = w.segment AND r.i = w.i + 1)))""",
        f"ranked{tag}",
    )
    cte(
        f"clustered{tag}",
        f"""SELECT *, i = first_i AS head FROM (
  SELECT r.*, w.cluster, min(r.i) OVER c AS first_i, count(*) OVER c AS members
  FROM ranked{tag} r JOIN walk{tag} w ON r.contig = w.contig AND r.segment = w.segment AND r.i = w.i
  WINDOW c AS (PARTITION BY r.contig, r.segment, w.cluster)) WHERE members > 1""",
        f"ranked{tag}", f"walk{tag}",
    )
    cte(
        f"mergedpos{tag}",
        f"""SELECT * REPLACE (CAST(CASE WHEN 30.0::DOUBLE * sig_windows / len < {cover}::DOUBLE THEN filter | 16 ELSE filter END AS BIGINT) AS filter)
FROM (SELECT contig, segment, cluster, avg(lr) AS lr, max(CASE WHEN head THEN filter END) AS filter,
             max(CASE WHEN head THEN p END) AS head_p, max(CASE WHEN head THEN len0 END) AS init_len,
             count(*) FILTER (WHERE head OR filter = 0) AS sig_windows,
             list_sort(list(pos) FILTER (WHERE head OR filter = 0))[count(*) FILTER (WHERE head OR filter = 0) // 2 + 1] AS pos,
             list_sort(list(len) FILTER (WHERE head OR filter = 0))[count(*) FILTER (WHERE head OR filter = 0) // 2 + 1] AS len
      FROM clustered{tag} GROUP BY contig, segment, cluster)""",
        f"clustered{tag}",
    )
    cte(
        f"members{tag}",
        f"""SELECT c.contig, c.segment, c.cluster, c.p, c.len0, count(*) OVER (PARTITION BY c.contig, c.segment, c.cluster) AS n
FROM clustered{tag} c JOIN mergedpos{tag} m ON {_CALL_OF.format('c')}
WHERE c.win_pos > m.pos AND c.win_pos - 30 < m.pos + m.len""",
        f"clustered{tag}", f"mergedpos{tag}",
    )
    # the upper median over all windows, in which windows without the sample count as zero
    middle = ", ".join(
        f"coalesce(list_sort(list({c}))[nullif(greatest(max(m.n) // 2 - (max(m.n) - count(*)), -1) + 1, 0)], 0) AS {c}" for c in COUNTS
    )
    cte(
        f"mgt{tag}",
        f"""SELECT contig, segment, cluster, sample, n_windows,
       CAST(r0 + CASE WHEN r1 <> r2 AND r0 = r1 AND x0 > x1 THEN 1 ELSE 0 END AS BIGINT) AS pl0,
       CAST(r1 + CASE WHEN r1 = r2 AND x1 > x2 OR r1 <> r2 AND r0 = r1 AND NOT x0 > x1 THEN 1 ELSE 0 END AS BIGINT) AS pl1,
       CAST(r2 + CASE WHEN r1 = r2 AND NOT x1 > x2 THEN 1 ELSE 0 END AS BIGINT) AS pl2, {', '.join(COUNTS)}
FROM (SELECT *, floor(x0 + 0.5) AS r0, floor(x1 + 0.5) AS r1, floor(x2 + 0.5) AS r2
      FROM (SELECT *, (s0 - low) / n_windows AS x0, (s1 - low) / n_windows AS x1, (s2 - low) / n_windows AS x2
            FROM (SELECT *, least(s0, s1, s2) AS low FROM (
              SELECT m.contig, m.segment, m.cluster, g.sample, max(m.n) AS n_windows, CAST(sum(pl0) AS DOUBLE) AS s0,
                     CAST(sum(pl1) AS DOUBLE) AS s1, CAST(sum(pl2) AS DOUBLE) AS s2, {middle}
              FROM members{tag} m JOIN {samples} g ON m.contig = g.contig AND m.p = g.p AND m.len0 = g.len0
              GROUP BY m.contig, m.segment, m.cluster, g.sample))))""",
        f"members{tag}", samples,
    )
    cte(
        f"calls{tag}",
        f"""SELECT m.*, a.alleles / 10.0::DOUBLE AS af FROM mergedpos{tag} m JOIN (
  SELECT contig, segment, cluster, sum(CASE WHEN pl0 = 0 THEN 0 WHEN pl1 = 0 THEN 1 ELSE 2 END) AS alleles
  FROM mgt{tag} GROUP BY contig, segment, cluster) a ON {_CALL_OF.format('a')}""",
        f"mergedpos{tag}", f"mgt{tag}",
    )
    zeros = ", ".join(f"coalesce(g.{c}, 0) AS {c}" for c in COUNTS)
    cte(
        f"cells{tag}",
        f"""SELECT contig, segment, cluster, sample, coalesce(g.pl0, 0) AS pl0, coalesce(g.pl1, 0) AS pl1, coalesce(g.pl2, 1) AS pl2,
       {zeros}, coalesce(h.first, 0) AS first, coalesce(h.last, 0) AS last
FROM mgt{tag} g FULL JOIN (SELECT m.contig, m.segment, m.cluster, s.sample, s.first, s.last FROM mergedpos{tag} m
  JOIN {samples} s ON s.contig = m.contig AND s.p = m.head_p AND s.len0 = m.init_len) h USING (contig, segment, cluster, sample)""",
        f"mgt{tag}", f"mergedpos{tag}", samples,
    )


samples_of("", "state")
for _tag, _failed in (("", False), ("_all", True)):
    merging(_tag, "wcalls", "gen", 10, 0.5, _failed)


def estimated_calls(rounds: int, min_len: int, min_lr: float, min_share: float) -> None:
    """Merged calls of the estimation stopped after some rounds: passing ones (``_est``) and all (``_estall``)."""
    n = unrolled_estimation(rounds, min_len, min_lr).removeprefix("em")
    cte(
        f"support{n}",
        f"""SELECT contig, p, len0, list_sort(list(start))[CAST(floor((count(*) - 1) * 0.8::DOUBLE + 0.5) AS BIGINT) + 1] AS pos,
       list_sort(list(end_pos))[CAST(floor((count(*) - 1) * (1 - 0.8::DOUBLE) + 0.5) AS BIGINT) + 1] AS end_pos
FROM (SELECT c.contig, c.p, c.len0, u.start, u.end_pos FROM usable u
      JOIN est{n} c ON u.contig = c.contig AND u.p = c.p JOIN quant q ON q.rg = u.rg
      WHERE u.dev BETWEEN c.len - q.lower_q AND c.len + q.upper_q)
GROUP BY contig, p, len0""",
        "usable", f"est{n}", "quant",
    )
    cte(
        f"wcalls{n}",
        f"""SELECT a.contig, CAST((a.p - f.first_p) // 10000 AS BIGINT) AS segment, a.p, a.len0, a.p - 1 AS win_pos, b.pos, b.end_pos, a.len, a.lr,
       CASE WHEN a.data_samples / 5.0::DOUBLE >= {min_share}::DOUBLE THEN 0 ELSE 4 END AS filter
FROM est{n} a JOIN support{n} b ON {_SAME.format('b')} JOIN {FIRST_POINTS} f ON a.contig = f.contig
WHERE b.pos <> 0 OR b.end_pos <> 0""",
        f"est{n}", f"support{n}", "b1",
    )
    samples = samples_of(n, f"est{n}")
    merging("_est", f"wcalls{n}", samples, 50, 0.5, False)
    merging("_estall", f"wcalls{n}", samples, 50, 0.5, True)


cte(
    "ladder",
    "SELECT * FROM (VALUES " + ", ".join(f"({q}, {k!r}::DOUBLE)" for q, k in enumerate(likelihood_ladder())) + ") AS t(q, k)",
)
# Alignment records.
cte(
    "reads",
    """SELECT l_orderkey AS qname, l_linestatus AS contig, l_returnflag AS rg, l_partkey AS pos, l_suppkey AS suppkey,
       l_extendedprice AS price, l_linenumber AS line, CAST(round(l_discount * 100) AS BIGINT) AS mapq,
       CAST(floor(l_quantity) AS BIGINT) AS l_seq, CAST(floor(l_extendedprice / 100) AS BIGINT) AS size,
       [33, 17, 97, 81, 1057, 289, 2081][l_linenumber] AS flag FROM lineitem""",
)
cte("rhist", "SELECT rg, size, count(*) AS cnt FROM reads GROUP BY rg, size", "reads")
cte(
    "rmed",
    """SELECT rg, CAST(min(size) AS BIGINT) AS median FROM (
  SELECT rg, size, sum(cnt) OVER (PARTITION BY rg ORDER BY size) AS upto, sum(cnt) OVER (PARTITION BY rg) AS total
  FROM rhist) WHERE upto * 2 >= total GROUP BY rg""",
    "rhist",
)
cte(
    "rmom",
    """SELECT h.rg, max(m.n) AS n, max(m.mean) AS mean,
       sqrt(sum(h.cnt * (h.size - m.mean) * (h.size - m.mean)) / (max(m.n) - 1)) AS stddev
FROM rhist h JOIN (SELECT rg, CAST(sum(cnt) AS BIGINT) AS n, CAST(sum(size * cnt) AS DOUBLE) / CAST(sum(cnt) AS DOUBLE) AS mean
                   FROM rhist GROUP BY rg) m ON h.rg = m.rg GROUP BY h.rg""",
    "rhist",
)
_TRIMMED = """SELECT rg, k, lo, hi, max(mean) AS mean, CAST(min(CASE WHEN upto * 2 >= n THEN size END) AS BIGINT) AS median,
       sqrt(sum(cnt * (size - mean) * (size - mean)) / (max(n) - 1)) AS stddev
FROM (SELECT t.rg, t.k, t.lo, t.hi, h.size, h.cnt, sum(h.cnt) OVER (PARTITION BY t.rg, t.k ORDER BY h.size) AS upto,
             sum(h.cnt) OVER (PARTITION BY t.rg, t.k) AS n,
             CAST(sum(h.size * h.cnt) OVER (PARTITION BY t.rg, t.k) AS DOUBLE) / CAST(sum(h.cnt) OVER (PARTITION BY t.rg, t.k) AS DOUBLE) AS mean
      FROM trim t JOIN rhist h ON h.rg = t.rg AND h.size >= t.lo AND h.size < t.hi) GROUP BY rg, k, lo, hi"""
cte(
    "trim",
    f"""SELECT DISTINCT rg, CAST(0 AS BIGINT) AS k, CAST(1 AS BIGINT) AS lo, CAST(19999 AS BIGINT) AS hi FROM rhist
UNION ALL
SELECT rg, k + 1, lo2, hi2 FROM (
  SELECT *, greatest(1, CAST(floor(median - 3 * stddev) AS BIGINT)) AS lo2,
         least(19999, CAST(ceil(median + 3 * stddev) AS BIGINT) + 1) AS hi2 FROM ({_TRIMMED}))
WHERE (lo2 <> lo OR hi2 <> hi) AND k < 1000""",
    "rhist",
)
cte("trimmed", f"SELECT * FROM ({_TRIMMED}) QUALIFY k = max(k) OVER (PARTITION BY rg)", "trim", "rhist")
cte(
    "itv",
    """SELECT o_orderkey AS itv, o_orderpriority AS contig,
       CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) * 100 + o_orderkey % 97 AS BIGINT) AS beg,
       CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) * 100 + o_orderkey % 97 AS BIGINT)
         + 1 + o_orderkey % 13 AS "end" FROM orders""",
)


# one pair after the other: those that ended are closed, the new one gets in while fewer than three are open
cte(
    "in_order",
    """SELECT contig, rg, start, dev, last_win, row_number() OVER (PARTITION BY contig, rg ORDER BY start, dev, last_win) AS k FROM pairs""",
    "pairs",
)
cte(
    "admission",
    """SELECT contig, rg, k, start, dev, last_win, true AS kept, [last_win] AS opened FROM in_order WHERE k = 1
UNION ALL
SELECT contig, rg, k, start, dev, last_win, len(still) < 3,
       CASE WHEN len(still) < 3 THEN list_append(still, last_win) ELSE still END
FROM (SELECT n.*, list_filter(a.opened, lambda e: e >= n.start // 30 * 30) AS still
      FROM admission a JOIN in_order n ON n.contig = a.contig AND n.rg = a.rg AND n.k = a.k + 1)""",
    "in_order",
)
