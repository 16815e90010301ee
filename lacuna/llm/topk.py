"""Exact top-k search by inner product over vectors in descending order of length.

Vectors are numbered blocks of descending norm. A basis that gathers most of the data's energy in its first
coordinates comes from the singular value decomposition, computed from the d x d Gram matrix that Spark sums up.
Every query meets the first block and gets a lower bound for its k-th score; it then meets only the
blocks whose largest norm times its own can still reach that bound. Within a block vectors are taken in
descending norm: a query stops at the first chunk that its bound excludes, the rotated head of the others
gives partial sums, and Cauchy-Schwarz on the two residual norms bounds what is missing. What survives is
scored exactly on the integer vectors. Queries and candidates meet in groups of two bounded blocks, so neither side is
ever whole in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.llm.common import batch_of, stage

SCALE = 1024
K = 10
QUERY_BLOCK = 4096
CANDIDATE_BLOCK = 32768
CHUNK = 1024
#: Share of the rotated coordinates in the partial sums.
HEAD = 0.25
_EXACT = float(1 << 53)
_LAST = (1 << 63) - 1
#: Components whose scaled value is no finite double count as non-finite.
_LARGEST = 1.7976931348623157e308 / SCALE


def scaled(values: np.ndarray) -> np.ndarray:
    """floor(1024 x) of doubles: whole numbers, exact as doubles because scaling by a power of two is."""
    return np.floor(values.astype(np.float64) * SCALE)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows padded with zeros to ``width``."""
    values = np.asarray(column.values, dtype=np.float64)
    offsets = np.asarray(column.offsets)
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), width))
    if len(values):
        at = np.arange(offsets[0], offsets[-1])
        row = np.repeat(np.arange(len(sizes)), sizes)
        out[row, at - np.repeat(offsets[:-1], sizes)] = values[at]
    return out


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, norm): rows that take part, v as whole doubles."""
    v = F.col(vector_col).cast("array<double>")
    kept = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(
        F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= _LARGEST))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("v")
            values = scaled(np.asarray(column.values, dtype=np.float64))
            lists = pa.ListArray.from_arrays(column.offsets, pa.array(values))
            norms = _norms(values, np.asarray(column.offsets))
            yield pa.RecordBatch.from_arrays([b.column("id"), lists, pa.array(norms)], names=["id", "v", "norm"])

    return kept.mapInArrow(run, "id long, v array<double>, norm double")


def _norms(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.array([np.linalg.norm(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.float64)


def _rotation(blocks: DataFrame, width: int) -> np.ndarray:
    """Orthonormal basis by descending singular values, from the summed Gram matrix."""
    schema = pa.schema([("i", pa.int32()), ("row", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((width, width))
        for b in batches:
            x = _matrix(b.column("v"), width)
            peak = np.abs(x).max(initial=0.0)
            x = x / peak if peak > 1e100 else x
            gram += x.T @ x
        yield batch_of(schema, [np.arange(width), list(gram)])

    parts = blocks.select("v").mapInArrow(run, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "x"))
    gram = np.zeros((width, width))
    for i, j, x in parts.groupBy("i", "j").agg(F.sum("x")).toLocalIterator():
        gram[i, j] = x
    if not np.isfinite(gram).all():
        return np.eye(width)
    return np.linalg.eigh((gram + gram.T) / 2)[1][:, ::-1]


class Search:
    """One block of queries against candidates in descending norm."""

    def __init__(self, uid: np.ndarray, q: np.ndarray, low: np.ndarray, rotation: np.ndarray, k: int):
        self.uid, self.q, self.k, self.rotation = uid, q, k, rotation
        self.norm = np.linalg.norm(q, axis=1)
        rotated = q @ rotation
        self.head = max(1, int(rotation.shape[1] * HEAD))
        self.q_head = rotated[:, : self.head]
        self.q_rest = np.linalg.norm(rotated[:, self.head :], axis=1)
        #: a score that k other candidates reach already; lower ones are out
        self.low = low.astype(np.float64)
        self.best: list[list[tuple[int, int]]] = [[] for _ in uid]

    def meet(self, uid: np.ndarray, key: np.ndarray, c: np.ndarray) -> None:
        for a in range(0, len(c), CHUNK):
            part = c[a : a + CHUNK]
            size = np.linalg.norm(part, axis=1)
            slack = 1e-9 * self.norm * size.max(initial=0.0) + 1e-6
            active = np.flatnonzero(~(self.norm * size.max(initial=0.0) + slack < self.low))
            if not len(active):
                return
            rotated = part @ self.rotation
            rest = np.linalg.norm(rotated[:, self.head :], axis=1)
            bound = self.q_head[active] @ rotated[:, : self.head].T + np.outer(self.q_rest[active], rest)
            near = ~(bound + slack[active, None] < self.low[active, None])  # what overflows is not excluded
            near &= self.uid[active][:, None] != uid[a : a + CHUNK][None, :]
            for row in np.flatnonzero(near.any(1)):
                at = active[row]
                cand = np.flatnonzero(near[row])
                self._take(at, _products(self.q[at], part[cand]), key[a + cand])

    def _take(self, at: int, scores: list[int], keys: np.ndarray) -> None:
        worst = self.best[at][-1][:2] if len(self.best[at]) == self.k else None
        fresh = [(-s, int(i)) for s, i in zip(scores, keys.tolist(), strict=True)]
        if worst is not None:
            fresh = [x for x in fresh if x < worst]
        if fresh:
            self.best[at] = sorted(self.best[at] + fresh)[: self.k]
            if len(self.best[at]) == self.k:
                self.low[at] = max(self.low[at], -self.best[at][-1][0])


def _products(q: np.ndarray, c: np.ndarray) -> list[int]:
    """Exact integer inner products; those that do not fit a long are cut off at its ends."""
    peak = np.abs(q).max(initial=0.0) * np.abs(c).max(initial=0.0) * max(1, len(q))
    if peak < _EXACT:
        return (c @ q).astype(np.int64).tolist()
    whole = [int(x) for x in q]
    found = (sum(a * int(b) for a, b in zip(whole, row, strict=True)) for row in c)
    return [max(-(1 << 63), min((1 << 63) - 1, x)) for x in found]


def search(
    vectors: DataFrame,
    is_query,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = K,
    query_block: int = QUERY_BLOCK,
    candidate_block: int = CANDIDATE_BLOCK,
) -> DataFrame:
    """(query_id, rank, id, score): the k rows of highest integer inner product per query row, ties to the smaller id.

    ``is_query`` is a condition on the column ``id``. A query's own row is no candidate, another row of equal id is.
    Null vectors and vectors with null or non-finite components take no part; an empty vector is all zeros, shorter
    vectors are padded with zeros. A null id sorts last. With fewer than k candidates all are returned.
    """
    usable = _usable(vectors, id_col, vector_col).withColumn("is_query", F.coalesce(is_query, F.lit(False)))
    rows = stage(usable.withColumn("uid", F.monotonically_increasing_id()), "vectors")
    n, width = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    names = "query_uid long, id long, score long, full boolean"
    if not n:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, id long, score long")
    width = max(1, width)
    parts = -(-n // candidate_block)
    ordered = rows.repartitionByRange(parts, F.desc("norm"), "uid").sortWithinPartitions(F.desc("norm"), "uid")
    blocks = stage(ordered.withColumn("block", F.spark_partition_id()), "blocks")
    rotation = _rotation(blocks, width)
    queries = rows.where("is_query").select("uid", "id", "v", "norm")
    groups = -(-max(1, queries.count()) // query_block)
    queries = queries.withColumn("qb", F.pmod(F.xxhash64("uid"), F.lit(groups)))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        q, c = left.combine_chunks(), right.combine_chunks()
        if not len(q) or not len(c):
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.bool_())], names=["query_uid", "id", "score", "full"])
        first = c.column("norm").to_numpy()
        order = np.lexsort((c.column("uid").to_numpy(), -first))
        found = Search(
            q.column("uid").to_numpy(), _matrix(q.column("v").chunk(0), width), q.column("low").to_numpy(), rotation, k
        )
        found.meet(
            c.column("uid").to_numpy()[order],
            np.where(c.column("id").is_null().to_numpy(), _LAST, c.column("id").fill_null(0).to_numpy())[order],
            _matrix(c.column("v").chunk(0), width)[order],
        )
        out = [(u, i if i != _LAST else None, -s) for u, best in zip(found.uid.tolist(), found.best, strict=True) for s, i in best]
        full = {u: len(best) == k for u, best in zip(found.uid.tolist(), found.best, strict=True)}
        return pa.table(
            [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int64()), pa.array([full[o[0]] for o in out], pa.bool_())],
            names=["query_uid", "id", "score", "full"],
        )

    def met(asked: DataFrame, met_blocks: DataFrame) -> DataFrame:
        """Queries with their lower bound and block number, against the candidates of these blocks."""
        copies = met_blocks.select("block", "uid", "id", "v", "norm", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("qb"))
        return asked.groupBy("qb", "block").cogroup(copies.groupBy("qb", "block")).applyInArrow(run, names)

    lowest = F.lit(float("-inf"))
    found = stage(met(queries.withColumn("block", F.lit(0)).withColumn("low", lowest), blocks.where("block = 0")), "first")
    peaks = dict(blocks.groupBy("block").agg(F.max("norm")).toLocalIterator())
    n_blocks = max(peaks) + 1
    if n_blocks > 1:
        bounds = found.where("full").groupBy("query_uid").agg(F.min("score").cast("double").alias("low"))
        asked = queries.join(bounds, F.col("uid") == F.col("query_uid"), "left").withColumn("low", F.coalesce("low", lowest))
        peak = F.array(*[F.lit(float(peaks.get(b, 0.0))) for b in range(1, n_blocks)])
        open_blocks = F.filter(
            F.sequence(F.lit(1), F.lit(n_blocks - 1)), lambda b: F.get(peak, b - 1) * F.col("norm") * (1 + 1e-9) + 1e-6 >= F.col("low")
        )
        asked = asked.select("qb", "uid", "v", "low", F.explode(open_blocks).alias("block"))
        found = found.union(met(asked, blocks.where("block > 0")))
    order = Window.partitionBy("query_uid").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names_of = queries.select(F.col("uid").alias("query_uid"), F.col("id").alias("query_id"))
    return ranked.join(names_of, "query_uid").select("query_id", "rank", "id", "score")
