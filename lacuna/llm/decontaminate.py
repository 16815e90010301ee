"""Benchmark decontamination: prefix-filtered containment join of benchmark windows against documents.

A unit is what has to be found whole: ``window`` consecutive words of an item, or all words of a shorter
item. As a set of (word, offset) elements a unit is contained in a document window of its own size only if
all elements are, so its necessary prefix is one element: its rarest, by the number of occurrences over all
documents (ties by the word). Documents are joined on these prefix words; the offset of the word inside the
unit gives the only possible place, whose position and length bounds are checked next; what remains is
verified word by word over the unit-sized window.

The benchmark is the stated query set. It is read in blocks of at most ``block_words`` words (or one item,
if that is longer), each block going to all tasks over the documents, so what is sent has a fixed bound.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm.common import ALNUM_TABLE, batch_of, column_bytes, keyed, slices

WINDOW = 10
#: Words of one block of benchmark items, at most; about 100 bytes each in a task.
BLOCK_WORDS = 500_000
_FIELDS = "id long, ord long, thash long, n_words long, hits array<long>, items array<string>"


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(ALNUM_TABLE).split()


def blocks_of(items: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items as (id, words), in blocks; rows come to the driver one partition at a time."""
    block: list[tuple[str, list[bytes]]] = []
    size = 0
    rows = items.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).toLocalIterator()
    for item_id, text in rows:
        words = words_of(None if text is None else text.encode())
        if not words:
            continue
        if block and size + len(words) > block_words:
            yield block
            block, size = [], 0
        block.append(("" if item_id is None else item_id, words))
        size += len(words)
    if block:
        yield block


def word_counts(docs: DataFrame, vocabulary: dict[bytes, int]) -> np.ndarray:
    """Occurrences of each benchmark word over all documents; a task returns one row per word it met."""
    schema = pa.schema([("w", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary) + 1, np.int64)
        for b in slices(batches):
            for text in column_bytes(b, "text"):
                total += np.bincount(_ids(words_of(text), vocabulary), minlength=len(total))
        met = np.flatnonzero(total[:-1])
        yield batch_of(schema, [met, total[met]])

    counted = docs.select("text").mapInArrow(run, "w int, n long").groupBy("w").agg(F.sum("n").alias("n"))
    out = np.zeros(len(vocabulary), np.int64)
    for w, n in counted.toLocalIterator():
        out[w] = n
    return out


def _ids(words: list[bytes], vocabulary: dict[bytes, int]) -> np.ndarray:
    """Word numbers; words outside the benchmark share the number after the last."""
    unknown = len(vocabulary)
    return np.fromiter((vocabulary.get(w, unknown) for w in words), np.int32, len(words))


class Index:
    """Units of one block under their prefix word."""

    def __init__(self, block: list[tuple[str, list[bytes]]], vocabulary: dict[bytes, int], rank: np.ndarray, window: int):
        self.vocabulary = vocabulary
        self.items: list[set[str]] = []
        units: dict[tuple[int, ...], int] = {}
        places: dict[int, dict[tuple[int, int], dict[bytes, int]]] = defaultdict(lambda: defaultdict(dict))
        for item_id, words in block:
            ids = [vocabulary[w] for w in words]
            size = min(window, len(ids))
            for k in range(len(ids) - size + 1):
                unit = tuple(ids[k : k + size])
                if unit not in units:
                    units[unit] = len(self.items)
                    self.items.append(set())
                    offset = min(range(size), key=lambda o: rank[unit[o]])
                    places[unit[offset]][offset, size][np.array(unit, np.int32).tobytes()] = units[unit]
                self.items[units[unit]].add(item_id)
        self.places = {w: dict(p) for w, p in places.items()}
        self.is_prefix = np.zeros(len(vocabulary) + 1, bool)
        self.is_prefix[list(self.places)] = True

    def search(self, ids: np.ndarray) -> tuple[np.ndarray, set[str]]:
        """Hit words as runs (start, end, start, end, ...) and the items with an occurring unit."""
        n = len(ids)
        edge = np.zeros(n + 1, np.int64)
        found: set[str] = set()
        at = np.flatnonzero(self.is_prefix[ids])
        for w in np.unique(ids[at]).tolist():
            seen = at[ids[at] == w]
            for (offset, size), units in self.places[w].items():
                start = seen - offset
                start = start[(start >= 0) & (start + size <= n)]
                for s in start.tolist():
                    unit = units.get(ids[s : s + size].tobytes())
                    if unit is not None:
                        edge[s] += 1
                        edge[s + size] -= 1
                        found |= self.items[unit]
        covered = np.cumsum(edge[:-1]) > 0
        return np.flatnonzero(np.diff(covered, prepend=False, append=False)), found


def _scan(docs: DataFrame, index: Index) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in slices(batches):
            n, hits, items = [], [], []
            for text in column_bytes(b, "text"):
                words = words_of(text)
                runs, found = index.search(_ids(words, index.vocabulary))
                n.append(len(words))
                hits.append(runs.tolist())
                items.append(sorted(found))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("ord"), b.column("thash"), pa.array(n, pa.int64()),
                 pa.array(hits, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))],
                names=["id", "ord", "thash", "n_words", "hits", "items"],
            )

    return docs.mapInArrow(run, _FIELDS)


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """(id, ord, thash, n_words, hits, items) per document row.

    ``hits`` are runs of hit words as start, end, start, end, ... (from 0, end exclusive), ``items`` the ids of
    the items with an occurring unit, sorted as text. Null and empty texts have no words and no hits. Items
    that are null or empty are skipped, a null item id counts as "". An item may be repeated. An
    empty benchmark gives rows without hits, an empty document table an empty result.
    """
    rows = keyed(docs, id_col, text_col)
    parts = [_scan(rows, index) for index in _indexes(rows, benchmark, item_col, item_text_col, window, block_words)]
    if not parts:
        parts.append(_scan(rows, Index([], {}, np.zeros(0, np.int64), window)))
    if len(parts) == 1:
        return parts[0]
    return _merged(parts)


def _indexes(rows: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, window: int, block_words: int) -> Iterator[Index]:
    """An index per benchmark block, its words ranked by their occurrences over all documents."""
    for block in blocks_of(benchmark, item_col, item_text_col, block_words):
        vocabulary: dict[bytes, int] = {}
        for _, words in block:
            for w in words:
                vocabulary.setdefault(w, len(vocabulary))
        counts = word_counts(rows, vocabulary)
        by_word = list(vocabulary)
        rank = np.empty(len(vocabulary), np.int64)
        rank[sorted(range(len(vocabulary)), key=lambda k: (counts[k], by_word[k]))] = np.arange(len(vocabulary))
        yield Index(block, vocabulary, rank, window)


def clean(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The rows of ``docs`` without any hit, with all their columns; no row is shuffled for it."""
    rows = docs.select(F.col(text_col).cast("string").alias("text"))
    out = docs
    for index in _indexes(rows, benchmark, item_col, item_text_col, window, block_words):
        out = out.where(~_hit(docs.sparkSession, index)(F.col(text_col).cast("string")))
    return out


def _hit(spark: SparkSession, index: Index):
    shared = spark.sparkContext.broadcast(index)

    @F.pandas_udf("boolean")
    def hit(texts: pd.Series) -> pd.Series:
        index = shared.value
        return pd.Series([bool(len(index.search(_ids(words_of(None if t is None else t.encode()), index.vocabulary))[0])) for t in texts], dtype=bool)

    return hit


def _merged(parts: list[DataFrame]) -> DataFrame:
    """Results of several benchmark blocks as one: their hit words and items are united per document row."""
    every = None
    for k, part in enumerate(parts):
        part = part.withColumn("block", F.lit(k))
        every = part if every is None else every.unionByName(part)
    spans = F.transform(
        F.sequence(F.lit(0), F.shiftright(F.size("hits"), 1) - 1),
        lambda k: F.struct(F.get("hits", k * 2).alias("a"), F.get("hits", k * 2 + 1).alias("b")),
    )
    spans = F.when(F.size("hits") > 0, spans).otherwise(F.expr("array()"))
    grouped = every.withColumn("spans", spans).groupBy("id", "ord", "thash").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_set("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.count_if(F.col("block") == 0).alias("copies"),
    )
    runs = F.aggregate(
        "spans",
        F.expr("cast(array() as array<bigint>)"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (s["a"] <= F.element_at(acc, -1)),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.greatest(F.element_at(acc, -1), s["b"]))),
        ).otherwise(F.concat(acc, F.array(s["a"], s["b"]))),
    )
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return grouped.select("id", "ord", "thash", "n_words", runs.alias("hits"), "items", copies.alias("copy")).drop("copy")
