"""Ranked lexical search: documents grouped by the mask of query terms they hold, masks by descending best score.

Spark counts documents, their terms and, per query term, the documents that hold it; documents are stored once as
their query terms with frequencies. A task then takes documents in blocks of bounded size. Per query term a
bitmap says which documents of the block hold it; the bitmaps of an item's terms, turned by 90 degrees, are
the presence masks of its documents. Documents of equal mask form a group, and the largest share each term
reaches in the block bounds what a mask can score. Groups are scored exactly in descending order of that bound until
the next one is below the item's k-th score so far, which a task carries from block to block. A window ranks what
the tasks return.

The items are the stated query set: they travel in blocks of at most ``block_words`` words, as in decontamination.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.llm.common import ALNUM_TABLE, batch_of, column_bytes, slices, stage

K = 10
#: Words of one block of items, and documents of one block, at most.
BLOCK_WORDS = 500_000
DOCUMENT_BLOCK = 8192
#: Query terms of one block of documents, at most (or one document).
BLOCK_TERMS = 2_000_000
#: Documents scored at once, at least, before the bound is looked at again.
STEP = 64
#: Fixed values of the score: a term's share is ``NUMERATOR * tf div (1000 * tf + 8 * m)``, m = FLAT + (LENGTH * n * N) div L.
NUMERATOR, LENGTH, FLAT = 1_000_000_000, 90, 10
_LAST = (1 << 63) - 1


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(ALNUM_TABLE).split()


@dataclass
class Items:
    """One block of items: their own numbers, ids, and distinct terms by number in ``vocabulary``."""

    uid: list[int]
    id: list
    terms: list[np.ndarray]
    vocabulary: dict[bytes, int]


def blocks_of(items: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[Items]:
    """Rows come to the driver one partition at a time; a row without terms has no results and is left out."""
    block, size = Items([], [], [], {}), 0
    rows = items.select(id_col, F.col(text_col).cast("string")).toLocalIterator()
    for uid, (item_id, text) in enumerate(rows):
        words = terms_of(None if text is None else text.encode())
        if not words:
            continue
        if block.uid and size + len(words) > block_words:
            yield block
            block, size = Items([], [], [], {}), 0
        numbers = sorted({block.vocabulary.setdefault(w, len(block.vocabulary)) for w in words})
        block.uid.append(uid)
        block.id.append(item_id)
        block.terms.append(np.array(numbers, np.int64))
        size += len(words)
    if block.uid:
        yield block


def _reduced(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(id, ord, n, terms, tfs): of every document with terms their number, and its query terms with frequencies."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            known = sent.value
            kept, sizes, terms, tfs = [], [], [], []
            for k, text in enumerate(column_bytes(b, "text")):
                words = terms_of(text)
                if not words:
                    continue
                found = [(known[w], c) for w, c in Counter(words).items() if w in known]
                kept.append(k)
                sizes.append(len(words))
                terms.append([x for x, _ in found])
                tfs.append([c for _, c in found])
            ids = b.column("id").take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))],
                names=["id", "n", "terms", "tfs"],
            )

    return docs.mapInArrow(run, "id long, n long, terms array<int>, tfs array<long>")


class Postings:
    """One block of documents by term, with each entry's share and each term's largest."""

    def __init__(self, batches: list[pa.RecordBatch], n_terms: int, documents: int, length: int):
        table = pa.Table.from_batches(batches).combine_chunks()
        self.ids = table.column("id").fill_null(_LAST).to_numpy()
        n = table.column("n").to_numpy()
        lists = table.column("terms").combine_chunks()
        doc = np.repeat(np.arange(len(n)), np.diff(np.asarray(lists.offsets)))
        term = lists.flatten().to_numpy().astype(np.int64)
        tf = table.column("tfs").combine_chunks().flatten().to_numpy()
        order = np.argsort(term, kind="stable")
        self.doc, term, tf = doc[order], term[order], tf[order]
        m = FLAT + np.array([LENGTH * int(x) * documents // length for x in n], np.int64)
        self.share = NUMERATOR * tf // (1000 * tf + 8 * m[self.doc])
        self.starts = np.searchsorted(term, np.arange(n_terms + 1))

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        a, z = self.starts[term], self.starts[term + 1]
        return self.doc[a:z], self.share[a:z]

    def best(self, terms: np.ndarray, weights: np.ndarray, known: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
        """The k best (-score, id) among ``known`` and this block's documents."""
        held = [(t, w, *self.of(t)) for t, w in zip(terms.tolist(), weights.tolist(), strict=True) if w > 0]
        held = [x for x in held if len(x[2])]
        if not held:
            return known
        most = np.array([w * int(share.max()) for _, w, _, share in held], np.int64)
        floor = -known[-1][0] if len(known) == k else 1
        if int(most.sum()) < floor:
            return known
        bitmaps = np.zeros((-(-len(held) // 64) * 64, len(self.ids)), np.uint8)
        for row, (_, _, docs, _) in zip(bitmaps, held, strict=False):
            row[docs] = 1
        masks = np.ascontiguousarray(np.packbits(bitmaps, axis=0, bitorder="little").T).view(np.uint64)
        group = np.zeros(len(masks), np.int64)
        for word in masks.T:  # 64 terms at a time
            _, inner = np.unique(word, return_inverse=True)
            _, first, group = np.unique(group * (int(inner.max()) + 1) + inner, return_index=True, return_inverse=True)
        bound = bitmaps[: len(held), first].T.astype(np.int64) @ most
        # documents by descending bound of their group; groups without any term are never reached
        by_bound = np.argsort(-bound[group], kind="stable")
        limits = bound[group][by_bound]
        at, end = 0, int(np.searchsorted(-limits, 0))
        out = known
        while at < end and limits[at] >= floor:
            step = min(end, int(np.searchsorted(-limits, -limits[min(at + STEP, end) - 1], "right")))
            chosen = np.sort(by_bound[at:step])
            score = np.zeros(len(chosen), np.int64)
            for _, w, docs, share in held:
                place = np.minimum(np.searchsorted(docs, chosen), len(docs) - 1)
                score += np.where(docs[place] == chosen, w * share[place], 0)
            good = score >= floor
            fresh = zip((-score[good]).tolist(), self.ids[chosen[good]].tolist(), strict=True)
            out = sorted([*out, *fresh])[:k]
            floor = -out[-1][0] if len(out) == k else 1
            at = step
        return out


def _ranked(reduced: DataFrame, items: Items, weights: np.ndarray, documents: int, length: int, k: int, document_block: int) -> DataFrame:
    """(item, id, score): the k best documents of every task per item."""
    sent = reduced.sparkSession.sparkContext.broadcast((items.terms, [weights[t] for t in items.terms], len(weights)))
    schema = pa.schema([("item", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
        held: list[pa.RecordBatch] = []
        rows = entries = 0
        for whole in batches:
            ends = np.cumsum(np.diff(np.asarray(whole.column("terms").offsets)))
            a = 0
            while a < whole.num_rows:
                room = np.searchsorted(ends, (ends[a - 1] if a else 0) + BLOCK_TERMS - entries, "right")
                z = min(max(int(room), a if held else a + 1), a + document_block - rows)
                if z > a:
                    held.append(whole.slice(a, z - a))
                    rows += z - a
                    entries += int(ends[z - 1] - (ends[a - 1] if a else 0))
                    a = z
                if a < whole.num_rows:
                    yield held
                    held, rows, entries = [], 0, 0
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, term_weights, n_terms = sent.value
        best: list[list[tuple[int, int]]] = [[] for _ in terms]
        for held in blocks(batches):
            block = Postings(held, n_terms, documents, length)
            best = [block.best(t, w, known, k) for t, w, known in zip(terms, term_weights, best, strict=True)]
        found = [(j, i, -s) for j, known in enumerate(best) for s, i in known]
        ids = pa.array([i if i != _LAST else None for _, i, _ in found], pa.int64())
        yield batch_of(schema, [[j for j, _, _ in found], ids, [s for _, _, s in found]])

    return reduced.select("id", "n", "terms", "tfs").mapInArrow(run, "item long, id long, score long")


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def search(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    k: int = K,
    block_words: int = BLOCK_WORDS,
    document_block: int = DOCUMENT_BLOCK,
) -> DataFrame:
    """(item_id, rank, id, score): the k documents of highest positive score per row of ``items``, ties to the smaller id.

    Terms are runs of letters, digits and characters beyond ASCII, A-Z in lower case; an item's repeated terms count once.
    Null and empty texts have no terms: such documents count nowhere, such items have no results. Repeated rows are rows
    of their own on both sides. A null document id sorts last; a null item id is given back. An item gets fewer rows where
    fewer documents score above zero. Empty tables give an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = items.schema[item_col].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, id long, score long")
    for number, block in enumerate(blocks_of(items, item_col, item_text_col, block_words)):
        reduced = stage(_reduced(rows, block.vocabulary), f"terms-{number}")
        documents, length = reduced.agg(F.count("*"), F.sum("n")).first()
        if not documents:
            return out
        weights = np.array([weight(documents, 0)] * len(block.vocabulary), np.int64)
        for term, holding in reduced.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():
            weights[term] = weight(documents, holding)
        found = _ranked(reduced, block, weights, documents, length, k, document_block)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(block.id)), f"item long, item_id {kind}")
        out = out.union(best.join(names, "item").select("item_id", "rank", "id", "score"))
    return out
