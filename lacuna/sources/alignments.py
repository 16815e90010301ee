"""BAM files as a Spark data source.

The index (``.bai``) tells in which spans of the file the records of a region are, and names places at which records
start, so a file is cut into ranges of whole records without reading it, and ranges are decoded by separate tasks.
Regions given to ``read_bam`` and filters on ``contig`` and ``pos`` that Spark pushes down both reach the index: what
lies outside is never read. Bases and qualities are skipped. CRAM is not read.

Files lie on a local disk that every node mounts under the same path, or at an address that Arrow's file systems open
(``hdfs://``, ``s3://``, ``gs://``, ``file://``).
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)

from lacuna.functions.reads import header_read_group
from lacuna.functions.regions import sample_name
from lacuna.params import ParameterError
from lacuna.sources import bam_index
from lacuna.sources.bam_records import decode, load_block, stretches

SCHEMA = (
    "path string, contig string, pos int, mapq int, flag int, l_seq int, mate_contig string, mate_pos int,"
    " tlen int, cigar array<struct<op:string,n:int>>, qname string, rg string, as_score int"
)

#: Compressed bytes per task, and files whose indices are read at the same time.
RANGE_BYTES = 32 << 20
PLANNERS = 16
#: The position of a record on no contig, and the one below which all positions end.
UNPLACED, LAST = -1, 1 << 31


def open_file(path: str):
    """A seekable file on a local disk or at an address."""
    if "://" not in path:
        return open(path, "rb")  # noqa: SIM115
    system, at = fs.FileSystem.from_uri(path)
    return system.open_input_file(at)


class Blocks:
    """Decompressed bytes from the start of a file, block by block."""

    def __init__(self, file) -> None:
        self.file, self.data, self.at, self.next_block, self.block = file, b"", 0, 0, 0

    def tell(self) -> int:
        """Virtual offset of the next byte; the end of a block counts as the start of the next one."""
        return self.next_block << 16 if self.at >= len(self.data) else self.block << 16 | self.at

    def read(self, n: int) -> bytes:
        parts = []
        while n > 0:
            if self.at >= len(self.data):
                if (loaded := load_block(self.file)) is None:
                    break
                self.data, self.at, self.block = loaded[0], 0, self.next_block
                self.next_block += loaded[1]
            parts.append(self.data[self.at : self.at + n])
            self.at += len(parts[-1])
            n -= len(parts[-1])
        return b"".join(parts)


def read_header(path: str) -> tuple[str, list[tuple[str, int]], int]:
    """Header text, contigs and the offset of the first record."""
    with open_file(path) as file:
        blocks = Blocks(file)
        if blocks.read(4) != b"BAM\x01":
            raise ValueError(f"{path} is not a BAM file")
        text = blocks.read(struct.unpack("<i", blocks.read(4))[0]).rstrip(b"\0").decode()
        contigs = []
        for _ in range(struct.unpack("<i", blocks.read(4))[0]):
            name = blocks.read(struct.unpack("<i", blocks.read(4))[0])[:-1].decode()
            contigs.append((name, struct.unpack("<i", blocks.read(4))[0]))
        return text, contigs, blocks.tell()


def read_index(path: str) -> list[bam_index.ContigIndex]:
    try:
        with open_file(f"{path}.bai") as f:
            return bam_index.parse_index(f.read())
    except FileNotFoundError as e:
        raise ParameterError(f"index of {path} is missing") from e


@dataclass
class Wanted:
    """What a scan is asked for: contigs (None: all), regions of contigs, and bounds of the start position."""

    contigs: set[str] | None = None
    regions: dict[str, list[tuple[int, int]]] | None = None
    low: int = UNPLACED
    high: int = LAST

    @property
    def everything(self) -> bool:
        return self.contigs is None and self.regions is None and not self.bounded

    @property
    def bounded(self) -> bool:
        return self.low > UNPLACED or self.high < LAST

    @property
    def unplaced(self) -> bool:
        """Whether records on no contig, whose position is ``UNPLACED``, may be wanted."""
        return self.contigs is None and self.regions is None and self.low <= UNPLACED < self.high

    def of(self, contig: str) -> list[tuple[int, int]]:
        """Regions of a contig in which wanted records lie, ascending and disjoint."""
        if (self.contigs is not None and contig not in self.contigs) or self.low >= self.high:
            return []
        if self.regions is None:
            return [(max(0, self.low), self.high)]
        # a record of a region may start before it; its start is held against the bounds later
        return [r for r in self.regions.get(contig, []) if r[0] < self.high and (r[1] > self.low)]

    def record_filter(self, contigs: list[str]):
        """Per batch of record heads, first without and then with the bases they cover, the records to keep."""
        if self.everything:
            return lambda head, covered: None
        places = [self.of(c) for c in contigs]
        listed = np.array([bool(p) for p in places] + [self.unplaced])  # the last one stands for no contig

        def keep(head: np.ndarray, covered: np.ndarray | None) -> np.ndarray | None:
            if covered is None:
                return listed[head["ref"]] & (head["pos"] >= self.low) & (head["pos"] < self.high)
            if self.regions is None:
                return None
            out = np.zeros(len(head), bool)
            for ref in np.unique(head["ref"]):
                mine = head["ref"] == ref
                beg, end = (np.array(x, np.int64) for x in zip(*places[ref], strict=True))
                pos = head["pos"][mine].astype(np.int64)
                # the first region that ends behind the record's start is the only one that has to be looked at
                at = np.searchsorted(end, pos, "right")
                inside = at < len(beg)
                inside[inside] = (pos + np.maximum(1, covered[mine]))[inside] > beg[at[inside]]
                out[mine] = inside
            return out

        return keep


@dataclass
class Range(InputPartition):
    path: str
    begin: int
    end: int


def plan_ranges(path: str, range_bytes: int, wanted: Wanted | None = None) -> list[Range]:
    """Cuts the spans of a file that hold wanted records into ranges of whole records."""
    wanted = wanted or Wanted()
    _, contigs, first = read_header(path)
    index = read_index(path)
    starts = sorted({first, *(x for one in index for x in one.starts())})
    if wanted.everything:
        spans = [(first, bam_index.END)]
    else:
        spans = []
        for (name, _), one in zip(contigs, index, strict=True):
            if regions := wanted.of(name):
                spans += bam_index.spans_over(one, regions)
        if wanted.unplaced:
            spans.append((max((e for one in index for found in one.bins.values() for _, e in found), default=first), bam_index.END))
        spans = bam_index.joined(spans)
    return [Range(path, a, b) for a, b in bam_index.pieces(spans, starts, range_bytes)]


class BamReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = json.loads(options["paths"])
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.wanted = Wanted()
        if options.get("contigs"):
            self.wanted.contigs = set(json.loads(options["contigs"]))
        if options.get("regions"):
            self.wanted.regions = {c: [tuple(r) for r in rs] for c, rs in json.loads(options["regions"]).items()}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes what bounds contig or start position. Spark tests every filter again, so all are given back."""
        for f in filters:
            on = getattr(f, "attribute", None)
            if on == ("contig",) and isinstance(f, EqualTo | In):
                named = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted.contigs = named if self.wanted.contigs is None else self.wanted.contigs & named
            elif on == ("pos",) and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                if not isinstance(f, LessThan | LessThanOrEqual):
                    self.wanted.low = max(self.wanted.low, f.value + isinstance(f, GreaterThan))
                if not isinstance(f, GreaterThan | GreaterThanOrEqual):
                    self.wanted.high = min(self.wanted.high, f.value + (not isinstance(f, LessThan)))
        return filters

    def partitions(self) -> list[Range]:
        with ThreadPoolExecutor(PLANNERS) as pool:
            return [r for rs in pool.map(lambda p: plan_ranges(p, self.range_bytes, self.wanted), self.paths) for r in rs]

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing is wanted
            return
        names = [name for name, _ in read_header(partition.path)[1]]
        contigs, keep = pa.array(names, pa.string()), self.wanted.record_filter(names)
        with open_file(partition.path) as file:
            for data, starts in stretches(file, partition.begin, partition.end):
                yield decode(partition.path, data, starts, contigs, keep)


class BamSource(DataSource):
    """``spark.read.format("bam").option("paths", ...)``; paths, contigs and regions are JSON."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BamReader:
        return BamReader({k.lower(): v for k, v in self.options.items()})


def read_bam(
    spark: SparkSession,
    paths: str | list[str],
    contigs: list[str] | None = None,
    range_bytes: int = RANGE_BYTES,
    regions: Iterable[tuple[str, int, int]] | None = None,
) -> DataFrame:
    """Alignment records of one or more files; the sample is the file's base name.

    ``regions`` (contig, begin, end), 0-based and half-open, keep the records that overlap one of them, each once.
    Spark's own pushdown for Python sources is switched on for the session, so filters on contig and pos prune as well.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BamSource)
    reader = spark.read.format("bam").option("rangebytes", str(range_bytes)).option(
        "paths", json.dumps([paths] if isinstance(paths, str) else list(paths))
    )
    if contigs is not None:
        reader = reader.option("contigs", json.dumps(list(contigs)))
    if regions is not None:
        reader = reader.option("regions", json.dumps(disjoint(regions)))
    rows = reader.load()
    return rows.withColumn("sample", sample_name(F.col("path"))).drop("path")


def disjoint(regions: Iterable[tuple[str, int, int]]) -> dict[str, list[tuple[int, int]]]:
    """Regions by contig, ascending; those that overlap or touch are one."""
    out: dict[str, list[tuple[int, int]]] = {}
    for contig, beg, end in sorted((c, max(0, b), min(e, LAST)) for c, b, e in regions):
        mine = out.setdefault(contig, [])
        if mine and beg <= mine[-1][1]:
            mine[-1] = (mine[-1][0], max(mine[-1][1], end))
        elif beg < end:
            mine.append((beg, end))
    return out


def read_regions(
    spark: SparkSession, paths: list[str], regions: Iterable[tuple[str, int, int]], samples: list[str] | None = None
) -> DataFrame:
    """Records of the regions, of all files or of those of some samples."""
    if samples is not None:
        named = spark.createDataFrame([(p,) for p in paths], "path string").withColumn("sample", sample_name(F.col("path")))
        wanted = set(samples)
        paths = [r["path"] for r in named.collect() if r["sample"] in wanted]
    return read_bam(spark, paths, regions=regions)


def _headers(paths: str | list[str]) -> list[tuple[str, tuple[str, list[tuple[str, int]], int]]]:
    paths = [paths] if isinstance(paths, str) else list(paths)
    with ThreadPoolExecutor(PLANNERS) as pool:
        return list(zip(paths, pool.map(read_header, paths), strict=True))


def bam_contigs(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Contigs of the headers in header order; files of different references are an error."""
    first, *others = _headers(paths)
    for path, (_, contigs, _) in others:
        if contigs != first[1][1]:
            raise ParameterError(f"{path} has other contigs than {first[0]}")
    rows = [(name, i, length) for i, (name, length) in enumerate(first[1][1])]
    return spark.createDataFrame(rows, "contig string, contig_id bigint, len bigint")


def bam_read_groups(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Read groups of the headers, by sample."""
    rows = [(path, line) for path, (text, _, _) in _headers(paths) for line in text.splitlines() if line.startswith("@RG")]
    lines = spark.createDataFrame(rows, "path string, value string")
    return lines.select(header_read_group(F.col("value")).alias("rg"), sample_name(F.col("path")).alias("sample")).where(F.col("rg") != "")
