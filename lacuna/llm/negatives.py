"""Hard-negative mining with exact integer scores from a residue number system.

Vectors become whole numbers. Blocks of anchors and candidates are multiplied modulo several small primes:
centred residues in single precision, in slices of coordinates short enough that every partial sum stays below
2^24, so that the fast float32 product is exact whatever its order of summation. Chinese remaindering puts
the residues of one score together to the exact signed number; as many primes are taken as the largest possible
score of the two blocks needs. Two passes over the same blocks: the best rows of the anchor's own label are its
positives; then, per positive, the best rows of other labels inside its band of scores. Each pass keeps a block's
best per anchor, and a window ranks them over all blocks.

Candidates stay in bounded blocks, sorted by label; anchors, the stated query set, are copied to the blocks they
have to meet and stream past them. A block of one label only meets anchors of that label in the first pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from lacuna.llm.common import batch_of, stage

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
#: A negative's score lies between these tenths of the positive's score.
LOW_TENTHS, HIGH_TENTHS = 3, 9
#: Rows of one candidate block, and scores that a task holds at once.
CANDIDATE_BLOCK = 32768
LEAST_BLOCK = 2048
SCORES = 1 << 20
_EXACT32 = 1 << 24
_LONG = (1 << 63) - 1
_LARGEST = 1.7976931348623157e308 / SCALE


def _primes(most: int) -> list[int]:
    sieve = np.ones(most + 1, bool)
    sieve[:2] = False
    for k in range(2, int(most**0.5) + 1):
        sieve[k * k :: k] &= not sieve[k]
    return np.flatnonzero(sieve).tolist()


#: Moduli in the order of use: the large ones below 512, whose products allow slices of 256 coordinates, then larger ones.
PRIMES = sorted((p for p in _primes(4096) if p > 64), key=lambda p: (p > 512, -p if p < 512 else p))


def moduli(bound: int) -> list[int]:
    """The primes whose product exceeds the number of integers from -bound to bound."""
    out, product = [], 1
    for p in PRIMES:
        if product > 2 * bound + 1:
            break
        out.append(p)
        product *= p
    return out


def residues(x: np.ndarray, p: int) -> np.ndarray:
    """Whole doubles modulo p, centred around zero, in single precision."""
    r = np.fmod(x, p)
    r[r > p // 2] -= p
    r[r < -(p // 2)] += p
    return r.astype(np.float32)


def product_modulo(a: np.ndarray, c: np.ndarray, p: int) -> np.ndarray:
    """a @ c.T modulo p (signed residues), exact in single precision."""
    width = max(1, (_EXACT32 - 1) // (p // 2) ** 2)
    total = np.zeros((len(a), len(c)), np.float32)
    for k in range(0, a.shape[1], width):
        total = np.fmod(total + np.fmod(a[:, k : k + width] @ c[:, k : k + width].T, np.float32(p)), np.float32(p))
    return total


def remaindered(parts: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Signed numbers from their residues: mixed-radix digits one prime after the other."""
    whole = np.int64 if np.prod([float(p) for p in primes]) < 2.0**62 else object
    total, radix = np.zeros(parts[0].shape, whole), 1
    for r, p in zip(parts, primes, strict=True):
        digit = (r.astype(np.int64) - (total % p).astype(np.int64)) * pow(radix, -1, p) % p
        total = total + digit.astype(whole) * radix
        radix *= p
    total = np.where(total > radix // 2, total - radix, total)
    return total if whole is np.int64 else np.clip(total, -_LONG - 1, _LONG).astype(np.int64)


class Block:
    """Candidates of one block with their residues, made once per prime."""

    def __init__(self, batches: list[pa.RecordBatch], width: int):
        table = pa.Table.from_batches(batches).combine_chunks()
        self.width = width
        self.uid = table.column("uid").to_numpy()
        self.id = _ids(table.column("id"))
        #: labels as numbers of this block; others are -1
        self.number = {x: k for k, x in enumerate(dict.fromkeys(table.column("label").to_pylist()))}
        self.label = self.numbers(table.column("label"))
        self.v = matrix(table.column("v").combine_chunks(), width)
        self.peak = int(np.abs(self.v).max(initial=0.0))
        self._by_prime: dict[int, np.ndarray] = {}

    def numbers(self, labels: pa.Array | pa.ChunkedArray) -> np.ndarray:
        return np.fromiter((self.number.get(x, -1) for x in labels.to_pylist()), np.int32, len(labels))

    def scores(self, a: np.ndarray) -> np.ndarray:
        """Exact inner products of whole vectors with all candidates, held at the ends of a long."""
        bound = self.width * self.peak * int(np.abs(a).max(initial=0.0))
        primes = moduli(bound)
        for p in primes:
            if p not in self._by_prime:
                self._by_prime[p] = residues(self.v, p)
        return remaindered([product_modulo(residues(a, p), self._by_prime[p], p) for p in primes], primes)


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    """A null id sorts after all others."""
    return column.fill_null(_LONG).to_numpy()


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """floor(SCALE x) of every component, as doubles; rows padded with zeros to ``width``."""
    sizes = np.diff(np.asarray(column.offsets))
    out = np.zeros((len(sizes), width))
    values = np.asarray(column.flatten(), np.float64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.floor(values * SCALE)
    return out


def best(scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest allowed scores of every row, ties to the smaller id, then to the earlier column."""
    held = np.where(allowed, scores, -_LONG - 1)
    if held.shape[1] > k:
        least = np.partition(held, held.shape[1] - k, axis=1)[:, held.shape[1] - k]
        allowed = allowed & (scores >= least[:, None])
    row, col = np.nonzero(allowed)
    order = np.lexsort((col, ids[col], ~scores[row, col], row))  # ~x descends with x and never overflows
    row, col = row[order], col[order]
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, int)
    rank = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))
    return row[rank < k], col[rank < k]


def _usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, v): the rows that take part; single precision stays so."""
    single = isinstance(vectors.schema[vector_col].dataType, ArrayType) and isinstance(vectors.schema[vector_col].dataType.elementType, FloatType)
    v = F.col(vector_col).cast("array<float>" if single else "array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), v.alias("v"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) <= _LARGEST))
    return rows.where(F.col("label").isNotNull() & F.col("v").isNotNull() & good)


def mine(
    vectors: DataFrame,
    is_anchor,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    candidate_block: int = CANDIDATE_BLOCK,
    least_block: int = LEAST_BLOCK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every anchor and positive.

    ``is_anchor`` is a condition on the column ``id``. Scores are inner products of floor(256 x); higher ones come first, ties
    by the smaller id. Positives are the first ``positives`` other rows of the anchor's label, negatives the
    first ``negatives`` rows of other labels with 3/10 to 9/10 of the positive's score. Rows with a null label, a null
    vector or a null or non-finite component take no part; an empty vector is all zeros, shorter ones are padded with
    zeros. A row is not its own positive; another row of equal id may be. A null id is no anchor and sorts last. Scores
    beyond a long are held at its ends. No anchors, or an empty table: no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    usable = _usable(vectors, id_col, vector_col, label_col).withColumn("uid", F.monotonically_increasing_id())
    rows = stage(usable, "vectors")
    n, width = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    width = max(1, width)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(-(-n // candidate_block), min(tasks, -(-n // least_block)))
    dealt = rows.repartitionByRange(parts, "label", "uid").withColumn("block", F.spark_partition_id())
    blocks = stage(dealt, "blocks")
    parts = blocks.agg(F.max("block")).first()[0] + 1
    anchors = stage(rows.where(F.coalesce(is_anchor, F.lit(False)) & F.col("id").isNotNull()), "anchors")

    def met(asked: DataFrame, run, names: str) -> DataFrame:
        """``run`` over every block, its candidates first, then the anchors that ask for it."""
        none = F.lit(None).cast("array<struct<rank:int,low:long,high:long>>")
        sides = blocks.select("block", F.lit(0).alias("side"), "uid", "id", "label", "v", none.alias("bands")).unionByName(
            asked.select("block", F.lit(1).alias("side"), "uid", "id", "label", "v", "bands")
        )
        return sides.repartitionById(parts, "block").sortWithinPartitions("block", "side").mapInArrow(run, names)

    # pass 1: positives, in blocks that hold the label
    own = blocks.select("block", "label").distinct()
    asked = anchors.join(own, "label").withColumn("bands", F.lit(None).cast("array<struct<rank:int,low:long,high:long>>"))
    found = met(asked, _positives(width, positives), "anchor long, uid long, id long, score long")
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), F.asc_nulls_last("id"), "uid")
    chosen = stage(found.withColumn("p", F.row_number().over(order)).where(F.col("p") <= positives), "positives")

    # pass 2: negatives inside the band of each positive, in all blocks
    band = F.struct(F.col("p").alias("rank"), _tenths(LOW_TENTHS, 9).alias("low"), _tenths(HIGH_TENTHS, 0).alias("high"))
    bands = chosen.groupBy("anchor").agg(F.collect_list(band).alias("bands"))
    asked = anchors.join(bands, F.col("uid") == F.col("anchor")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    found = met(asked, _negatives(width, negatives), "anchor long, p int, uid long, id long, score long")
    order = Window.partitionBy("anchor", "p").orderBy(F.desc("score"), F.asc_nulls_last("id"), "uid")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    ranked = ranked.select("anchor", "p", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    names = anchors.select(F.col("uid").alias("anchor"), F.col("id").alias("anchor_id"))
    pairs = chosen.select("anchor", "p", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return ranked.join(pairs, ["anchor", "p"]).join(names, "anchor").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


def _tenths(tenths: int, up: int):
    """floor((tenths * score + up) / 10) of the column ``score`` without leaving a long: with ``up`` 9 it rounds up."""
    tens = "(score div 10 - int(score < 0 and score % 10 <> 0))"
    return F.expr(f"{tens} * {tenths} + (pmod(score, 10) * {tenths} + {up}) div 10")


def _streamed(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[Block, pa.RecordBatch]]:
    """(block, anchors) in slices of bounded size; the rows are sorted by block and side."""
    waiting: list[pa.RecordBatch] = []
    block, number = None, None
    for whole in batches:
        key = np.stack([whole.column("block").to_numpy(), whole.column("side").to_numpy()])
        cuts = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(0), True]) if whole.num_rows else [0]
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            b = whole.slice(a, z - a)
            at, side = key[0, a], key[1, a]
            if at != number:
                waiting, block, number = [], None, at
            if side == 0:
                waiting.append(b)
                continue
            if block is None:
                block, waiting = Block(waiting, width), []
            step = max(1, SCORES // len(block.uid))
            for k in range(0, b.num_rows, step):
                yield block, b.slice(k, step)


def _positives(width: int, k: int):
    schema = pa.schema([("anchor", pa.int64()), ("uid", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, a in _streamed(batches, width):
            scores = block.scores(matrix(a.column("v"), width))
            uid = a.column("uid").to_numpy()
            same = block.numbers(a.column("label"))[:, None] == block.label[None, :]
            row, col = best(scores, same & (uid[:, None] != block.uid[None, :]), block.id, k)
            yield batch_of(schema, [uid[row], block.uid[col], _nulled(block.id[col]), scores[row, col]])

    return run


def _negatives(width: int, k: int):
    schema = pa.schema([("anchor", pa.int64()), ("p", pa.int32()), ("uid", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, a in _streamed(batches, width):
            scores = block.scores(matrix(a.column("v"), width))
            uid = a.column("uid").to_numpy()
            other = block.numbers(a.column("label"))[:, None] != block.label[None, :]
            bands = a.column("bands")
            of = np.repeat(np.arange(len(uid)), np.diff(np.asarray(bands.offsets)))
            flat = bands.flatten()
            rank, low, high = (flat.field(c).to_numpy() for c in ("rank", "low", "high"))
            for p in np.unique(rank):
                mine = rank == p
                at = of[mine]
                s = scores[at]
                row, col = best(s, other[at] & (s >= low[mine][:, None]) & (s <= high[mine][:, None]), block.id, k)
                yield batch_of(
                    schema, [uid[at[row]], np.full(len(row), p), block.uid[col], _nulled(block.id[col]), s[row, col]]
                )

    return run


def _nulled(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == _LONG)
