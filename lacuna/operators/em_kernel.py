"""Length/frequency estimation of many grid points at once, vectorised over Arrow batches.

Input rows are run-length observations sorted by candidate. Whole candidates are gathered until a
batch is worth the vector overhead, so memory follows the batch size and not the partition size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from lacuna.functions.genotype import CELL_HET_FROM, CELL_HOM_FROM, EQUAL_WITHIN, PSEUDO

#: Observations gathered before a batch is solved.
BATCH_OBS = 200_000

LOG2, LOG10 = np.log(2.0), np.log(10.0)
SAME_FREQUENCY = 1e-4
#: A mean this close below a whole number counts as that number before it is truncated.
SAME_WHOLE = 1e-9


@dataclass(frozen=True)
class Settings:
    n_samples: int
    min_len: int
    min_lr: float
    iterations: int
    cell_population: bool
    strict: bool


@dataclass
class ReadGroups:
    """Densities of the read groups of a batch, concatenated."""

    flat: np.ndarray
    base: np.ndarray
    slots: np.ndarray
    rebase: np.ndarray
    min_prob: np.ndarray
    stddev: np.ndarray
    lower_q: np.ndarray
    upper_q: np.ndarray

    def density(self, rg: np.ndarray, dev: np.ndarray) -> np.ndarray:
        i = dev + self.rebase[rg]
        regular = (i > 0) & (i + 1 < self.slots[rg])
        return np.where(regular, self.flat[self.base[rg] + np.where(regular, i, 0)], self.min_prob[rg])


@dataclass
class Block:
    """Observations of a set of candidates: entries -> read groups -> samples -> candidates."""

    dev: np.ndarray
    cnt: np.ndarray
    e_g: np.ndarray
    g_s: np.ndarray
    g_rg: np.ndarray
    s_c: np.ndarray
    n_c: int

    @property
    def e_rg(self) -> np.ndarray:
        return self.g_rg[self.e_g]

    @property
    def e_s(self) -> np.ndarray:
        return self.g_s[self.e_g]

    @property
    def e_c(self) -> np.ndarray:
        return self.s_c[self.e_s]

    @property
    def g_c(self) -> np.ndarray:
        return self.s_c[self.g_s]

    def subset(self, keep: np.ndarray) -> tuple[Block, np.ndarray, np.ndarray]:
        """Block of the kept candidates plus masks of the kept samples and read groups."""
        s_keep = keep[self.s_c]
        g_keep = s_keep[self.g_s]
        e_keep = g_keep[self.e_g]
        new_c, new_s, new_g = (np.cumsum(m) - 1 for m in (keep, s_keep, g_keep))
        return (
            Block(
                self.dev[e_keep], self.cnt[e_keep], new_g[self.e_g[e_keep]], new_s[self.g_s[g_keep]],
                self.g_rg[g_keep], new_c[self.s_c[s_keep]], int(keep.sum()),
            ),
            s_keep,
            g_keep,
        )


def _sum(index: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(index, weights=weight, minlength=n)


def fallback(d: np.ndarray) -> np.ndarray:
    low = d.min(axis=1) if len(d) else np.zeros(0)
    bad = (low == 0) | (low > 1 - EQUAL_WITHIN)
    d[bad] = (1.0, PSEUDO, PSEUDO)
    return d


def scaled(logs: np.ndarray) -> np.ndarray:
    return np.exp(logs - logs.max(axis=1, keepdims=True))


def pair_densities(b: Block, rgs: ReadGroups, length: np.ndarray, shift: np.ndarray):
    ref = rgs.density(b.e_rg, b.dev - shift[b.e_g])
    dl = rgs.density(b.e_rg, b.dev - length[b.e_c])
    return ref, dl


def log_likelihoods(b: Block, ref: np.ndarray, dl: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log likelihoods of the three genotypes per read group and per sample."""
    terms = (np.log(ref), np.log(ref + dl) - LOG2, np.log(dl))
    per_group = np.stack([_sum(b.e_g, b.cnt * t, len(b.g_s)) for t in terms], axis=1)
    per_sample = np.stack([_sum(b.g_s, per_group[:, k], len(b.s_c)) for k in range(3)], axis=1)
    return per_group, per_sample


def priors(af: np.ndarray, cell_population: bool) -> np.ndarray:
    if not cell_population:
        g = np.stack([(1 - af) ** 2, 2 * af * (1 - af), af * af], axis=1)
        return np.maximum(g, PSEUDO)
    out = np.full((len(af), 3), PSEUDO)
    mixed = af <= CELL_HET_FROM
    het = ~mixed & (af < CELL_HOM_FROM)
    out[mixed, 0] = np.maximum(1 - 2 * af[mixed] + PSEUDO, PSEUDO)
    out[mixed, 1] = np.maximum(2 * af[mixed] - 2 * PSEUDO, PSEUDO)
    out[het, 1] = 1.0
    out[~mixed & ~het, 2] = 1.0
    return out


def _absent(b: Block, n_samples: int) -> np.ndarray:
    return n_samples - np.bincount(b.s_c, minlength=b.n_c)


def allele_sums(b: Block, d: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Posterior allele counts of the samples at hand."""
    p = d * g[b.s_c]
    return _sum(b.s_c, (p[:, 1] + 2 * p[:, 2]) / p.sum(axis=1), b.n_c)


def frequency_update(b: Block, d: np.ndarray, g: np.ndarray, n_samples: int) -> np.ndarray:
    alleles = allele_sums(b, d, g)
    q = g * np.array([1.0, PSEUDO, PSEUDO])
    alleles += _absent(b, n_samples) * (q[:, 1] + 2 * q[:, 2]) / q.sum(axis=1)
    return alleles / 2.0 / n_samples


def ratio_sums(b: Block, d: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Log ratios of the samples at hand."""
    p = d * g[b.s_c]
    mixed = (p * d).sum(axis=1) / p.sum(axis=1)
    return _sum(b.s_c, np.log(mixed) - np.log(d[:, 0]), b.n_c)


def likelihood_ratio(b: Block, d: np.ndarray, g: np.ndarray, n_samples: int) -> np.ndarray:
    lr = ratio_sums(b, d, g)
    blank = np.array([1.0, PSEUDO, PSEUDO])
    q = g * blank
    return lr + _absent(b, n_samples) * np.log((q * blank).sum(axis=1) / q.sum(axis=1))


def length_sums(
    b: Block, rgs: ReadGroups, ref: np.ndarray, dl: np.ndarray,
    d: np.ndarray, group_d: np.ndarray, g: np.ndarray,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weight and first moment of the deviations per candidate, and the next shift per read group."""
    p = d * g[b.s_c]
    a = p / p.sum(axis=1, keepdims=True)
    q = group_d * g[b.g_c]
    r = q / q.sum(axis=1, keepdims=True)
    e_s, both = b.e_s, ref + dl
    from_del = b.cnt * (a[e_s, 1] * dl / both + a[e_s, 2])
    from_ref = b.cnt * (r[b.e_g, 1] * ref / both + r[b.e_g, 0])
    e_c = b.e_c
    weight = _sum(e_c, from_del, b.n_c)
    moment = _sum(e_c, from_del * b.dev, b.n_c)
    with np.errstate(divide="ignore", invalid="ignore"):
        w = _sum(b.e_g, from_ref, len(b.g_s))
        mean = _sum(b.e_g, from_ref * b.dev, len(b.g_s)) / w
        shift = np.where(w > 0, np.trunc(mean + np.sign(mean) * SAME_WHOLE), 0.0)
    limit = rgs.stddev[b.g_rg]
    return weight, moment, np.where(np.abs(shift) > limit, 0, shift).astype(np.int64)


def mean_length(weight: np.ndarray, moment: np.ndarray) -> np.ndarray:
    mean = np.divide(moment, weight, out=np.zeros(len(weight)), where=weight > 0)
    return np.floor(np.maximum(mean, 0.0) + 0.5).astype(np.int64)


def frequency_seed(b: Block, rgs: ReadGroups, length: np.ndarray) -> np.ndarray:
    size, sd = length[b.e_c], rgs.stddev[b.e_rg]
    low = np.maximum(size // 2, np.floor(size - 2 * sd + 0.5))
    high = np.floor(size + 2 * sd)
    inside = _sum(b.e_c, b.cnt * ((b.dev > low) & (b.dev < high)), b.n_c)
    total = _sum(b.e_c, b.cnt, b.n_c)
    return np.divide(inside, total, out=np.zeros(b.n_c), where=total > 0)


@dataclass
class Solution:
    length: np.ndarray
    shift: np.ndarray
    af: np.ndarray
    prior: np.ndarray
    rounds: np.ndarray


def solve(b: Block, rgs: ReadGroups, len0: np.ndarray, s: Settings) -> Solution:
    """Alternates length and frequency until a length recurs with the same frequency."""
    af = frequency_seed(b, rgs, len0)
    sol = Solution(len0.copy(), np.zeros(len(b.g_s), np.int64), af, priors(af, s.cell_population),
                   np.zeros(b.n_c, np.int64))
    # one column per round; a later visit of a length counts before an earlier one
    seen_len = np.full((b.n_c, s.iterations), -1, np.int64)
    seen_af = np.zeros((b.n_c, s.iterations))
    alive = af > 0
    for k in range(s.iterations):
        alive &= sol.length >= s.min_len
        if not alive.any():
            break
        cand = np.flatnonzero(alive)
        sub, _, g_keep = b.subset(alive)
        length, shift, prior = sol.length[cand], sol.shift[g_keep], sol.prior[cand]
        sol.rounds[cand] += 1
        seen_len[cand, k], seen_af[cand, k] = length, sol.af[cand]

        ref, dl = pair_densities(sub, rgs, length, shift)
        group_logs, sample_logs = log_likelihoods(sub, ref, dl)
        d = fallback(scaled(sample_logs))
        weight, moment, new_shift = length_sums(sub, rgs, ref, dl, d, scaled(group_logs), prior)
        new_length = mean_length(weight, moment)

        ref, dl = pair_densities(sub, rgs, new_length, new_shift)
        new_d = fallback(scaled(log_likelihoods(sub, ref, dl)[1]))
        new_af = frequency_update(sub, new_d, prior, s.n_samples)
        lost = new_af == 0
        new_prior = np.where(lost[:, None], prior, priors(new_af, s.cell_population))

        again = seen_len[cand, : k + 1] == new_length[:, None]
        latest = k - np.argmax(again[:, ::-1], axis=1)
        settled = again.any(axis=1) & ~lost & (np.abs(seen_af[cand, latest] - new_af) <= SAME_FREQUENCY)
        # Of the last two estimates the one with the better ratio stays; weights are not restored.
        lr_now = likelihood_ratio(sub, new_d, new_prior, s.n_samples)
        lr_before = likelihood_ratio(sub, d, prior, s.n_samples)
        back = settled & (lr_before > lr_now)
        sol.length[cand] = np.where(back, length, new_length)
        sol.af[cand] = np.where(back, sol.af[cand], new_af)
        sol.prior[cand] = new_prior
        sol.shift[g_keep] = np.where(back[sub.g_c], shift, new_shift)
        alive[cand[settled | lost]] = False
    return sol


def final(b: Block, rgs: ReadGroups, sol: Solution, s: Settings, ratio: Callable) -> dict[str, np.ndarray]:
    """Likelihood ratio per candidate; phred scores and pair classes per sample."""
    ref, dl = pair_densities(b, rgs, sol.length, sol.shift)
    logs = log_likelihoods(b, ref, dl)[1]
    d = fallback(scaled(logs))
    out: dict[str, np.ndarray] = {"lr": ratio(b, d, sol.prior)}

    ten = logs / LOG10
    empty = ten.sum(axis=1) == 0.0
    gap = ten.max(axis=1, keepdims=True) - ten
    gap[(gap < EQUAL_WITHIN).all(axis=1) & ~empty] = (0.0, 10.0, 10.0)
    pl = np.floor(10.0 * gap + 0.5).astype(np.int64)
    pl[empty] = 0
    for k in range(3):
        out[f"pl{k}"] = pl[:, k]

    e_s, n_s = b.e_s, len(b.s_c)
    is_ref = ref >= 2 * dl
    is_del = ~is_ref & (dl >= 2 * ref)
    for name, test in (("lad_ref", is_ref), ("lad_amb", ~is_ref & ~is_del), ("lad_del", is_del)):
        out[name] = _sum(e_s, b.cnt * test, n_s).astype(np.int64)

    low = sol.length[b.e_c] - rgs.lower_q[b.e_rg]
    high = sol.length[b.e_c] + rgs.upper_q[b.e_rg]
    in_ref = b.dev <= rgs.upper_q[b.e_rg]
    both = in_ref & (b.dev >= (high if s.strict else low))
    beyond = ~in_ref & (b.dev >= low)
    for name, test in (
        ("dad_ref", in_ref & ~both),
        ("dad_both", both),
        ("dad_between", ~in_ref & (b.dev < low)),
        ("dad_alt", beyond & (b.dev <= high)),
        ("dad_right", beyond & (b.dev > high)),
    ):
        out[name] = _sum(e_s, b.cnt * test, n_s).astype(np.int64)
    return out


def _changes(*codes: np.ndarray) -> np.ndarray:
    """True where a row of sorted codes differs from the one before."""
    first = np.zeros(len(codes[0]), bool)
    first[:1] = True
    for c in codes:
        first[1:] |= c[1:] != c[:-1]
    return first


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)


def _candidate_changes(table: pa.Table) -> np.ndarray:
    return _changes(_codes(table["contig"]), table["p"].to_numpy(), table["len0"].to_numpy())


@dataclass
class Gathered:
    """Whole candidates of a table sorted by candidate, sample and read group."""

    table: pa.Table
    block: Block
    rgs: ReadGroups
    c_row: np.ndarray
    s_row: np.ndarray
    n_active: np.ndarray
    first: np.ndarray
    last: np.ndarray

    def rows(self, sub: Block, s_keep: np.ndarray, passing: np.ndarray, found: dict, per_candidate: dict) -> dict[str, pa.Array]:
        """Columns of the passing samples; scores of samples with fewer than two pairs are 0."""
        covered = self.n_active[s_keep] >= 2
        for k in range(3):
            found[f"pl{k}"][~covered] = 0
        c = sub.s_c[passing]
        take = pa.array(self.s_row[s_keep][passing])
        low, high = self.first[s_keep][passing], self.last[s_keep][passing]
        columns = {name: self.table[name].take(take).combine_chunks() for name in ("contig", "p", "len0", "sample")}
        columns["data_samples"] = pa.array(_sum(sub.s_c, covered, sub.n_c).astype(np.int64)[c])
        columns["lead"] = pa.array(_changes(sub.s_c)[passing])
        columns["first"] = pa.array(low, mask=low == NONE)
        columns["last"] = pa.array(high, mask=high == -1)
        columns |= {name: pa.array(values[c]) for name, values in per_candidate.items()}
        return columns | {name: pa.array(values[passing]) for name, values in found.items() if name != "lr"}


NONE = np.iinfo(np.int64).max


def gather(table: pa.Table, new_c: np.ndarray, resolve: Callable) -> Gathered:
    """``new_c`` marks the first row of every candidate."""
    return gather_as(table, np.cumsum(new_c) - 1, int(new_c.sum()), resolve)


def gather_as(table: pa.Table, cand: np.ndarray, n_c: int, resolve: Callable) -> Gathered:
    """The same with a number of the candidate per row; a candidate may have no row."""
    new_c = _changes(cand)
    new_s = new_c | _changes(_codes(table["sample"]))
    ok = ~table["high_cov"].to_numpy().astype(bool)
    samp = np.cumsum(new_s) - 1
    s_row = np.flatnonzero(new_s)
    cnt = table["cnt"].to_numpy().astype(float)
    rows = np.flatnonzero(ok)
    usable = table.take(pa.array(rows))
    rg, rgs = resolve(usable)
    new_g = _changes(samp[rows], rg) if len(rows) else np.zeros(0, bool)
    g_row = np.flatnonzero(new_g)
    block = Block(
        dev=usable["dev"].to_numpy(), cnt=cnt[rows], e_g=np.cumsum(new_g) - 1, g_s=samp[rows][g_row],
        g_rg=rg[g_row], s_c=cand[s_row], n_c=n_c,
    )
    first = np.full(len(s_row), NONE)
    last = np.full(len(s_row), -1)
    np.minimum.at(first, samp[rows], usable["first"].to_numpy())
    np.maximum.at(last, samp[rows], usable["last"].to_numpy())
    n_active = np.bincount(samp, weights=cnt, minlength=len(s_row))
    return Gathered(table, block, rgs, np.flatnonzero(new_c), s_row, n_active, first, last)


def _solve_table(
    table: pa.Table, resolve: Callable, out_schema: pa.Schema, s: Settings
) -> pa.RecordBatch | None:
    """Solves the whole candidates of a table sorted by candidate, sample and read group."""
    got = gather(table, _candidate_changes(table), resolve)
    block, rgs = got.block, got.rgs
    sol = solve(block, rgs, table["len0"].to_numpy()[got.c_row], s)
    good = (sol.af >= PSEUDO) & (sol.length >= s.min_len)
    if not good.any():
        return None
    sub, s_keep, g_keep = block.subset(good)
    kept = np.flatnonzero(good)
    small = Solution(sol.length[kept], sol.shift[g_keep], sol.af[kept], sol.prior[kept], sol.rounds[kept])
    found = final(sub, rgs, small, s, lambda b, d, g: likelihood_ratio(b, d, g, s.n_samples))
    passing = (found["lr"] >= s.min_lr)[sub.s_c]
    if not passing.any():
        return None
    scalars = {"iterations": small.rounds, "len": small.length, "lr": found["lr"], "af": small.af}
    columns = got.rows(sub, s_keep, passing, found, scalars)
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in out_schema], schema=out_schema)


def shared_read_groups(ids: list, arrays: dict[str, np.ndarray]) -> Callable:
    """Read groups by identifier from one table."""
    position = {rg: i for i, rg in enumerate(ids)}
    stats = ReadGroups(**arrays)

    def resolve(rows: pa.Table) -> tuple[np.ndarray, ReadGroups]:
        encoded = rows["rg"].combine_chunks().dictionary_encode()
        codes = np.array([position[v] for v in encoded.dictionary.to_pylist()], dtype=np.int64)
        return codes[encoded.indices.to_numpy(zero_copy_only=False)], stats

    return resolve


def whole_candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole candidates from a sorted stream, each worth the vector overhead."""
    pending: list[pa.RecordBatch] = []
    waiting = 0
    for batch in batches:
        pending.append(batch)
        waiting += batch.num_rows
        if waiting < BATCH_OBS:
            continue
        table = pa.Table.from_batches(pending)
        cut = int(np.flatnonzero(_candidate_changes(table))[-1])
        if cut == 0:
            continue
        yield table.slice(0, cut)
        pending = table.slice(cut).combine_chunks().to_batches()
        waiting = sum(b.num_rows for b in pending)
    if waiting:
        yield pa.Table.from_batches(pending)


def kernel(resolve: Callable, out_schema: pa.Schema, s: Settings) -> Callable:
    """Function for ``mapInArrow`` over partitions that hold whole, sorted candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_candidates(batches):
            result = _solve_table(table, resolve, out_schema, s)
            if result is not None:
                yield result

    return run
