"""WARC archives with a two-level capture index.

Writing. Every row becomes one WARC/1.1 record, a gzip member of its own. Records of equal payload (of at least
``MIN_SHARED`` bytes) are one response, that of the smallest id, and revisits that refer to it. Tasks write
archive files of bounded size to the shared folder, through the file system its address names; a retried task
writes files of its own, and only those that the committed index names are read.

Index. Captures are sorted by their reversed-host URL key over range partitions (shards) and packed into compressed
blocks of ``BLOCK_LINES`` lines. The directory holds one line per block, its first key.

Reading. A lookup finds its shard among the shards' first keys and its block in the shard's directory by binary
search, opens that block only, searches it, and reads the byte range of the record it names.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import NO_ID, batch_of, stage
from lacuna.session import run_folder

MIN_SHARED = 100
#: Compressed bytes after which a task starts another archive file.
ARCHIVE_BYTES = 256 << 20
#: Compressed bytes of archives that one task reads.
READ_BYTES = 4 << 20
BLOCK_LINES = 3000
#: Index blocks of one shard, about.
SHARD_BLOCKS = 16
DATE = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def surt(url: str | None) -> str:
    """Reversed-host key: ``com,example,www)/path?query``. What is no URL with a host is its own key."""
    url = (url or "").strip()
    try:
        parts = urlsplit(url)
        host, port = parts.hostname, parts.port
    except ValueError:
        return url
    if not host:
        return url
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port else "")
    return f"{key}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record; a revisit keeps the HTTP header of the full payload and leaves the payload out."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}"]
    head.append(f"WARC-Target-URI: {quote(url or '', safe=''.join(map(chr, range(33, 127))))}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisit:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Fields of one record. The digest of a response is taken from its payload and must be the declared one."""
    head, rest = raw.split(b"\r\n\r\n", 1)
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:] if ": " in line)
    block = rest[: int(fields["Content-Length"])]
    if lines[0] != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a whole record")
    http, payload = block.split(b"\r\n\r\n", 1)
    size = int(http.rsplit(b"Content-Length: ", 1)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("a payload differs from its digest")

    def page(name: str) -> int | None:
        number = fields.get(name, "<urn:page:>")[10:-1]
        return int(number) if number else None

    return dict(
        page_id=page("WARC-Record-ID"), url=fields.get("WARC-Target-URI", ""), payload_bytes=size, payload_digest=digest, record_type=kind,
        refers_to=page("WARC-Refers-To"), payload=payload.decode() if kind == "response" else None,
    )


# ---------------------------------------------------------------- writing


def with_references(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(page_id, url, html, digest, refers_to); only ids and digests are grouped, pages are joined by both."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("ord"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"),
    )
    rows = rows.withColumn("digest", F.sha2("html", 256))
    long = rows.where(F.octet_length("html") >= MIN_SHARED).select("ord", "digest")
    first = long.groupBy("digest").agg(F.min("ord").alias("first"), F.max("ord").alias("last")).where("first < last")
    later = long.join(first, "digest").where("ord > first").select("ord", "digest", F.col("first").alias("refers_to")).distinct()
    return rows.join(later, ["ord", "digest"], "left").select("page_id", "url", "html", "digest", "refers_to")


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes the archives; returns the stored captures (key, page_id, file, offset, length), one per row of ``pages``.

    A null payload is empty, a null URL has an empty key, a null id is larger than all others. Rows of the
    smallest id with equal payload are all responses. Repeated rows give a record each.
    """
    folder = f"{run_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex[:12]}"
    schema = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        out, number, at, name = None, 0, 0, ""
        for b in batches:
            found: list[tuple] = []
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{number}.warc.gz"
                    out, number, at = system.open_output_stream(f"{path}/{name}", compression=None), number + 1, 0
                member = gzip.compress(record(page_id, url, html.encode(), digest, refers_to), 5, mtime=0)
                out.write(member)
                found.append((surt(url), page_id, f"{folder}/{name}", at, len(member)))
                at += len(member)
            if found:
                yield batch_of(schema, zip(*found, strict=True))
        if out is not None:
            out.close()

    rows = with_references(pages, id_col, url_col, html_col)
    return stage(rows.mapInArrow(run, "key string, page_id long, file string, offset long, length long"), "captures")


def build_index(captures: DataFrame, block_lines: int = BLOCK_LINES, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """The stored index (shard, block, key, page_id, lines): ``lines`` is compressed, key and page_id are its first."""
    n = captures.count()
    shards = max(1, -(-n // (block_lines * shard_blocks)))
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("key", pa.string()), ("page_id", pa.int64()), ("lines", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, lines = TaskContext.get().partitionId(), 0, []

        def packed() -> pa.RecordBatch:
            head = lines[0].split("\t")
            body = zlib.compress("\n".join(lines).encode())
            return batch_of(schema, [[shard], [block], [_plain(head[0])], [int(head[1])], [body]])

        for b in batches:
            for key, page_id, file, offset, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                lines.append(f"{_escaped(key)}\t{page_id}\t{file}\t{offset}\t{length}")
                if len(lines) == block_lines:
                    yield packed()
                    block, lines = block + 1, []
        if lines:
            yield packed()

    rows = captures.select("key", F.coalesce("page_id", F.lit(NO_ID)).alias("page_id"), "file", "offset", "length")
    ordered = rows.repartitionByRange(shards, "key", "page_id").sortWithinPartitions("key", "page_id")
    return stage(ordered.mapInArrow(run, "shard int, block int, key string, page_id long, lines binary"), "index")


def _escaped(key: str) -> str:
    return key.replace("%", "%25").replace("\t", "%09").replace("\n", "%0A")


def _plain(key: str) -> str:
    return key.replace("%09", "\t").replace("%0A", "\n").replace("%25", "%")


# ---------------------------------------------------------------- reading


def lookup(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """(page_id, file, offset, length) of the captures with the (key, page_id) of ``wanted``; misses give no row.

    A null page_id in ``wanted`` asks for the capture without id. Repeated wishes count once.
    """
    spark = index.sparkSession
    starts = index.groupBy("shard").agg(F.min(F.struct(F.encode("key", "UTF-8").alias("k"), "page_id")).alias("first")).orderBy("shard")
    bounds, numbers = [], []
    for shard, first in starts.toLocalIterator():
        bounds.append((bytes(first["k"]), first["page_id"]))
        numbers.append(shard)
    asked = wanted.select("key", F.coalesce("page_id", F.lit(NO_ID)).alias("page_id")).distinct()
    if not bounds:
        return spark.createDataFrame([], "page_id long, file string, offset long, length long")

    @F.pandas_udf("int")
    def shard_of(keys: pd.Series, ids: pd.Series) -> pd.Series:
        return pd.Series([numbers[max(0, bisect_right(bounds, (k.encode(), i)) - 1)] for k, i in zip(keys, ids, strict=True)], dtype="int32")

    asked = asked.withColumn("shard", shard_of("key", "page_id"))
    schema = pa.schema([("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        wishes = sorted(zip((k.encode() for k in left.column("key").to_pylist()), left.column("page_id").to_pylist(), strict=True))
        order = sorted(range(len(right)), key=right.column("block").to_pylist().__getitem__)
        directory = [(right.column("key")[k].as_py().encode(), right.column("page_id")[k].as_py()) for k in order]
        found: list[tuple] = []
        opened, lines, keys = -1, [], []
        for wish in wishes:
            # equal lines may run over several blocks: start in the block before the first that begins at or behind the wish
            at = max(0, bisect_left(directory, wish) - 1)
            while at < len(directory) and directory[at] <= wish:
                if at != opened:
                    body = zlib.decompress(right.column("lines")[order[at]].as_py()).decode()
                    lines = [x.split("\t") for x in body.split("\n")]
                    keys = [(_plain(x[0]).encode(), int(x[1])) for x in lines]
                    opened = at
                for x in lines[bisect_left(keys, wish) : bisect_right(keys, wish)]:
                    found.append((None if wish[1] == NO_ID else wish[1], x[2], int(x[3]), int(x[4])))
                at += 1
        return pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*found, strict=True) if found else [[]] * 4, schema, strict=True)], schema=schema)

    met = asked.groupBy("shard").cogroup(index.groupBy("shard"))
    return met.applyInArrow(run, "page_id long, file string, offset long, length long")


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"


def read(captures: DataFrame) -> DataFrame:
    """The records at (file, offset, length), read by byte range; a file is opened once per task that needs it.

    The addresses are stored first: the bytes they stand for, not their own size, set the number of tasks.
    """
    names = [c.split()[0] for c in READ.split(", ")]
    types = [pa.int64() if c.endswith("long") else pa.string() for c in READ.split(", ")]
    schema = pa.schema(list(zip(names, types, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        for b in batches:
            rows = []
            for file, offset, length in zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                if file != name:
                    if source is not None:
                        source.close()
                    system, path = fs.FileSystem.from_uri(file)
                    name, source = file, system.open_input_file(path)
                found = parse_record(gzip.decompress(source.read_at(length, offset)))
                rows.append([found[c] for c in names])
                if len(rows) == 500:
                    yield batch_of(schema, zip(*rows, strict=True))
                    rows = []
            if rows:
                yield batch_of(schema, zip(*rows, strict=True))
        if source is not None:
            source.close()

    wanted = stage(captures.select("file", "offset", "length"), "wanted")
    parts = max(1, -(-(wanted.agg(F.sum("length")).first()[0] or 0) // READ_BYTES))
    ordered = wanted.repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(run, READ)


def keys_of(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(key, page_id) of every row."""

    @F.pandas_udf("string")
    def key(urls: pd.Series) -> pd.Series:
        return urls.map(surt, na_action=None)

    return pages.select(key(F.col(url_col).cast("string")).alias("key"), F.col(id_col).cast("long").alias("page_id"))
