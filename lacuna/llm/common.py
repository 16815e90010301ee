"""What the text operators share: staged tables, row identity, byte-level words and component search.

Row identity. Operators read an id and a text column only and ignore all others, whatever their names. A
row is addressed by its id and a hash of its text, so repeated ids with different texts stay apart and
repeated equal rows get equal results. A null id sorts after all others (``NO_ID``).
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.session import materialise

NO_ID = (1 << 63) - 1
#: Every byte that is no word byte becomes a blank; A-Z become a-z; all of 0x80 and above belongs to words.
ALNUM_TABLE = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256)
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once as Parquet in the shared run folder and reads it back.

    This cuts the lineage: later steps survive lost executors without running earlier ones again.
    """
    return materialise(df, name)


def keyed(docs: DataFrame, id_col: str, text_col: str, null_text: str | None = "") -> DataFrame:
    """(id, ord, thash, text): the id as given, the id to order by, a hash of the text, and the text."""
    text = F.col(text_col).cast("string")
    if null_text is not None:
        text = F.coalesce(text, F.lit(null_text))
    return docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("ord"),
        F.xxhash64(text).alias("thash"),
        text.alias("text"),
    )


def same_row(a: DataFrame, b: DataFrame) -> Column:
    return (a["ord"] == b["ord"]) & (a["thash"] == b["thash"])


def column_bytes(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def slices(batches: Iterable[pa.RecordBatch], name: str = "text", most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices of about ``most_bytes`` of the column ``name``, at least one row each.

    Batches are cut by rows, so their size follows the texts; slices keep what a task holds in Python small.
    """
    for b in batches:
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(b.column(name)), 0), dtype=np.int64))
        a = 0
        while a < b.num_rows:
            z = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most_bytes, "right"))
            z = max(a + 1, z)
            yield b.slice(a, z - a)
            a = z
    release()


def release() -> None:
    """Gives freed memory back to the system: a Python worker waits for its next task with what it holds."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def batch_of(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


def in_pieces(schema: pa.Schema, columns: list[np.ndarray], rows: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Record batches of bounded length from long arrays."""
    for k in range(0, len(columns[0]), rows):
        yield batch_of(schema, [c[k : k + rows] for c in columns])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has an edge; root is the smallest node of the component.

    Alternating large-star and small-star rounds: every round is two aggregations that combine before the
    shuffle and two joins whose large side adaptive execution may split, so a node with very many edges
    is never gathered. Rounds grow with the logarithm of the component size.
    """
    e = edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where("lo < hi").distinct()
    e = stage(e, "edges")
    before = _signature(e)
    while True:
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select("lo", "hi"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u and m < v").select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct()
        large = stage(large, "large")
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").where("m < lo").select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
        e = stage(small.union(low.select(F.col("m").alias("lo"), "hi")).distinct(), "edges")
        after = _signature(e)
        if after == before:
            break
        before = after
    roots = e.select("lo").distinct()
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(roots.select("lo", F.col("lo")))


def _signature(e: DataFrame) -> tuple:
    mixed = F.xxhash64("lo", "hi")
    return tuple(e.agg(F.count("*"), F.bit_xor(mixed), F.sum(mixed.bitwiseAND(F.lit(0xFFFFFFFF)))).first())
