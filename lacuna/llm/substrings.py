"""Substring deduplication: seed and extend on winnowed anchors, without pairs.

Seeds. Each window of ``WINDOW`` words has one anchor, its k-gram of lowest hash (the leftmost of equals), so equal
windows have equal anchors at equal places. Neighbouring windows that share their anchor form one run.
Documents are joined on anchors; anchors of one document only are left behind.

Extension. A run is its anchor extended both ways. Occurrences whose whole runs are equal form a class: all but
the ones in the class's smallest document are repeats at once, however many there are. Only class
representatives are extended window by window: the windows of all classes of an anchor are grouped by
(anchor, window hash), and a window is a repeat if a class of a smaller document has it.

Covered windows of a document are merged to maximal repeats of at least ``WINDOW`` words. Nothing is paired
within a group: a passage in a third of all documents is one class of one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import batch_of, column_bytes, in_pieces, keyed, slices, stage

WINDOW = 50
#: Words of an anchor. A window has WINDOW - ANCHOR + 1 of them, which bounds the windows of one run.
ANCHOR = 15
_BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
_CHUNK = 1 << 20
_POSITION = np.uint64((1 << 21) - 1)
_MOST_WORDS = 1 << 18


class _WordHashes(dict):
    """Hash per word, computed once; emptied when it holds very many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > _MOST_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.ones(n + 1, np.uint64)
    down = np.ones(n + 1, np.uint64)
    up[1:] = np.uint64(base)
    down[1:] = np.uint64(pow(base, -1, 1 << 64))
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Hasher:
    """Rolling hashes over the words of a text, for any start and length."""

    def __init__(self) -> None:
        self.words = _WordHashes()
        self.tables = [_powers(b, 1 << 10) for b in _BASES]

    def prefix(self, words: list[bytes], which: int) -> np.ndarray:
        n = len(words)
        if n >= len(self.tables[which][0]):
            self.tables[which] = _powers(_BASES[which], 2 * n)
        h = np.fromiter(map(self.words.__getitem__, words), np.uint64, n)
        if which:
            h = _mixed(h + np.uint64(which))
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(h * self.tables[which][0][:n], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, which: int, start: np.ndarray, size) -> np.ndarray:
        return _mixed((prefix[start + size] - prefix[start]) * self.tables[which][1][start])


def runs_of(words: list[bytes], hasher: Hasher, window: int = WINDOW, anchor: int = ANCHOR) -> list[np.ndarray]:
    """Anchor hash, run hash, first window and number of windows of every run."""
    n = len(words)
    parts: list[list[np.ndarray]] = [[], [], [], []]
    if n >= window:
        first, second = hasher.prefix(words, 0), hasher.prefix(words, 1)
        width = window - anchor + 1
        for a in range(0, n - window + 1, _CHUNK):
            m = min(_CHUNK, n - window + 1 - a)
            grams = hasher.spans(first, 0, np.arange(a, a + m + width - 1), anchor)
            low = (grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64)
            size = 1
            while 2 * size <= width:
                low = np.minimum(low[:-size], low[size:])
                size *= 2
            low = np.minimum(low[:m], low[width - size : width - size + m])
            at = (low & _POSITION).astype(np.int64)
            start = np.flatnonzero(np.diff(at, prepend=-1))
            count = np.diff(start, append=m)
            shape = ((at[start] - start) * 4096 + count).astype(np.uint64)
            run = hasher.spans(second, 1, a + start, count + window - 1) ^ _mixed(shape + np.uint64(1))
            for part, x in zip(parts, (grams[at[start]].view(np.int64), run.view(np.int64), a + start, count), strict=True):
                part.append(x)
    return [np.concatenate(p) if p else np.zeros(0, np.int64) for p in parts]


_RUNS = "anchor long, run long, ord long, thash long, pos int, n int"


def _runs(rows: DataFrame, window: int, anchor: int) -> DataFrame:
    schema = pa.schema([(c, pa.int64()) for c in ("anchor", "run", "ord", "thash")] + [("pos", pa.int32()), ("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in slices(batches):
            found: list[list[np.ndarray]] = [[] for _ in schema]
            for text, o, t in zip(column_bytes(b, "text"), b.column("ord").to_pylist(), b.column("thash").to_pylist(), strict=True):
                a, r, pos, n = runs_of(text.split(), hasher, window, anchor)
                for column, x in zip(found, (a, r, np.full(len(a), o), np.full(len(a), t), pos, n), strict=True):
                    column.append(x)
            yield from in_pieces(schema, [np.concatenate(c) for c in found])

    return rows.select("ord", "thash", "text").mapInArrow(run, _RUNS)


def _windows(rows: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """(anchor, run, ord, k, hash): the windows of the wanted runs, k counting within the run."""
    by_doc = wanted.groupBy("ord", "thash").agg(F.collect_list(F.struct("anchor", "run", "pos", "n")).alias("runs"))
    joined = rows.select("ord", "thash", "text").join(by_doc, ["ord", "thash"])
    schema = pa.schema([("anchor", pa.int64()), ("run", pa.int64()), ("ord", pa.int64()), ("k", pa.int32()), ("hash", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in slices(batches):
            lists = b.column("runs")
            fields = {c: lists.values.field(c).to_numpy() for c in ("anchor", "run", "pos", "n")}
            offsets = lists.offsets.to_pylist()
            found: list[list[np.ndarray]] = [[] for _ in schema]
            for row, (text, o) in enumerate(zip(column_bytes(b, "text"), b.column("ord").to_pylist(), strict=True)):
                a, r, pos, n = (fields[c][offsets[row] : offsets[row + 1]].astype(np.int64) for c in ("anchor", "run", "pos", "n"))
                k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                prefix = hasher.prefix(text.split(), 1)
                h = hasher.spans(prefix, 1, np.repeat(pos, n) + k, window).view(np.int64)
                for column, x in zip(found, (np.repeat(a, n), np.repeat(r, n), np.full(len(k), o), k, h), strict=True):
                    column.append(x)
            yield from in_pieces(schema, [np.concatenate(c) for c in found])

    return joined.mapInArrow(run, "anchor long, run long, ord long, k int, hash long")


def repeated_runs(rows: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(ord, thash, pos, n, mask): runs with repeated windows; bit k of mask marks window pos + k."""
    every = stage(_runs(rows, window, anchor), "runs")
    shared = every.groupBy("anchor").agg(F.min("ord").alias("least"), F.max("ord").alias("most")).where("least < most")
    seeds = stage(every.join(shared.select("anchor", "least"), "anchor"), "seeds")
    classes = seeds.groupBy("anchor", "run").agg(F.min("ord").alias("owner"))
    known = stage(seeds.join(classes, ["anchor", "run"]), "classes")
    ones = F.expr("shiftleft(1L, n) - 1")
    whole = known.where("ord > owner").select("ord", "thash", "pos", "n", ones.alias("mask"))

    several = known.select("anchor", "run").distinct().groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1")
    owners = known.where("ord = owner").join(several.select("anchor"), "anchor", "left_semi")
    one_each = owners.groupBy("anchor", "run").agg(F.min(F.struct("ord", "thash", "pos", "n")).alias("o"))
    windows = stage(_windows(rows, one_each.select("anchor", "run", "o.*"), window), "windows")
    first = windows.groupBy("anchor", "hash").agg(F.min("ord").alias("first"))
    later = windows.join(first, ["anchor", "hash"]).where("ord > first")
    masks = later.groupBy("anchor", "run").agg(F.bit_or(F.expr("shiftleft(1L, k)")).alias("mask"))
    partly = known.where("ord = owner and ord > least").join(masks, ["anchor", "run"]).select("ord", "thash", "pos", "n", "mask")
    return whole.union(partly)


def deduplicated(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR, with_text: bool = False
) -> DataFrame:
    """(id, n_words, n_removed, repeats, kept_sha256[, kept]) per document row.

    ``repeats`` are maximal runs of removed words as start, end, start, end, ... (end exclusive). Null and
    empty texts have no words. A repeat within one document, or between rows of equal id, is none; a null id is
    larger than all ids. Repeated rows give one row each.
    """
    rows = keyed(docs, id_col, text_col)
    spans = repeated_runs(rows, window, anchor).groupBy("ord", "thash").agg(F.collect_list(F.struct("pos", "n", "mask")).alias("spans"))
    joined = rows.join(spans, ["ord", "thash"], "left").select("id", "text", "spans")
    fields = [("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("repeats", pa.list_(pa.int64())), ("kept_sha256", pa.string())]
    schema = pa.schema(fields + [("kept", pa.string())] * with_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out: list[list] = [[] for _ in schema]
            lists = b.column("spans")
            part = {c: lists.values.field(c).to_numpy() for c in ("pos", "n", "mask")}
            offsets = lists.offsets.to_pylist()
            for row, (i, text) in enumerate(zip(b.column("id").to_pylist(), column_bytes(b, "text"), strict=True)):
                words = text.split()
                at = slice(offsets[row], offsets[row + 1])
                edges = _covered(len(words), part["pos"][at].astype(np.int64), part["n"][at].astype(np.int64), part["mask"][at], window)
                kept, a = [], 0
                for s, e in zip(edges[::2], edges[1::2], strict=True):
                    kept += words[a:s]
                    a = e
                joined = b" ".join(kept + words[a:] if edges else words)
                values = [i, len(words), sum(edges[1::2]) - sum(edges[::2]), edges, hashlib.sha256(joined).hexdigest()]
                for column, x in zip(out, values + [joined.decode()] * with_text, strict=True):
                    column.append(x)
            yield batch_of(schema, out)

    told = "id long, n_words long, n_removed long, repeats array<long>, kept_sha256 string"
    return joined.mapInArrow(run, told + ", kept string" * with_text)


def _covered(n_words: int, pos: np.ndarray, n: np.ndarray, mask: np.ndarray, window: int) -> list[int]:
    """Maximal runs of words that a marked window covers."""
    if not len(pos):
        return []
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = (np.repeat(pos, n) + k)[(np.repeat(mask, n) >> k) & 1 == 1]
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + window, -1)
    return np.flatnonzero(np.diff(np.cumsum(edge[:-1]) > 0, prepend=False, append=False)).tolist()
