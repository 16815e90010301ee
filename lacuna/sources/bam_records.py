"""Columnar decoding of BAM records: boundaries first, then every field of all records of a stretch at once.

A stretch of decompressed blocks is one byte array. The start of each record is found by hopping over the record
sizes; fixed fields are gathered into one structured array, names, operations and tags are copied from offsets into
Arrow buffers. Tags are walked one step per round for all records together. Nothing loops over fields in Python.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa

ARROW = pa.schema(
    [
        ("path", pa.string()), ("contig", pa.string()), ("pos", pa.int32()), ("mapq", pa.int32()),
        ("flag", pa.int32()), ("l_seq", pa.int32()), ("mate_contig", pa.string()), ("mate_pos", pa.int32()),
        ("tlen", pa.int32()), ("cigar", pa.list_(pa.struct([("op", pa.string()), ("n", pa.int32())]))),
        ("qname", pa.string()), ("rg", pa.string()), ("as_score", pa.int32()),
    ]
)

# Fixed values of the file format: the record's head, CIGAR operations in order, sizes of fixed-width tag values.
HEAD = np.dtype(
    [
        ("size", "<i4"), ("ref", "<i4"), ("pos", "<i4"), ("l_name", "u1"), ("mapq", "u1"), ("bin", "<u2"),
        ("n_cigar", "<u2"), ("flag", "<u2"), ("l_seq", "<i4"), ("mate_ref", "<i4"), ("mate_pos", "<i4"), ("tlen", "<i4"),
    ]
)
CIGAR_OPS = b"MIDNSHP=X"
ON_REFERENCE = b"MDN=X"
TAG_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
TAG_INTS = {"c": "i1", "C": "u1", "s": "<i2", "S": "<u2", "i": "<i4", "I": "<u4"}

#: Decompressed bytes that are decoded together.
WINDOW = 8 << 20

_SIZES = np.zeros(256, np.int64)
for _kind, _size in TAG_SIZES.items():
    _SIZES[ord(_kind)] = _size
_CONSUMES = np.array([op in ON_REFERENCE for op in CIGAR_OPS] + [False] * (16 - len(CIGAR_OPS)))


def load_block(file: BinaryIO) -> tuple[bytes, int] | None:
    """Content and compressed size of the block at the file's position; None at the end."""
    head = file.read(18)
    if len(head) < 18:
        return None
    if head[:4] != b"\x1f\x8b\x08\x04":
        raise ValueError("not a block-compressed file")
    size = struct.unpack_from("<H", head, 16)[0] + 1
    return zlib.decompress(file.read(size - 18)[:-8], -15), size


def boundaries(data: bytes, limit: int | None) -> tuple[np.ndarray, int]:
    """Starts of the complete records that begin before ``limit``, and where the first other one begins."""
    out, at, last = [], 0, len(data)
    read = struct.Struct("<i").unpack_from
    while at + 4 <= last and (limit is None or at < limit):
        end = at + 4 + read(data, at)[0]
        if end > last:
            break
        out.append(at)
        at = end
    return np.array(out, np.int64), at


def stretches(file: BinaryIO, begin: int, end: int, window: int = WINDOW) -> Iterator[tuple[bytes, np.ndarray]]:
    """(bytes, record starts) of the records from virtual offset ``begin`` up to ``end``, in stretches of about ``window`` bytes."""
    at, skip = begin >> 16, begin & 0xFFFF
    file.seek(at)
    pending, limit, more = b"", None, True
    while more and (limit is None or limit > 0):
        parts, total, loaded = [pending], len(pending), False
        while not loaded or (total < window and (limit is None or total < limit)):
            block = load_block(file)
            if block is None:
                more = False
                break
            data, size = block
            if limit is None and at >= end >> 16:
                limit = total + ((end & 0xFFFF) - skip if at == end >> 16 else 0)
            parts.append(data[skip:])
            total += len(data) - skip
            at, skip, loaded = at + size, 0, True
        data = b"".join(parts)
        starts, used = boundaries(data, limit)
        if len(starts):
            yield data, starts
        pending = data[used:]
        limit = None if limit is None else limit - used


def _flat(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of every piece, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def strings(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, there: np.ndarray | None = None) -> pa.Array:
    """Pieces of the byte array as an Arrow string column; null where ``there`` is false."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    mask = None if there is None else pa.array(there).buffers()[1]
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(data[_flat(starts, sizes)]), mask)


def numbers(data: np.ndarray, starts: np.ndarray, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(data[starts[:, None] + np.arange(width)]).view(kind).ravel()


def cigars(data: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Operations as lists of (op, n), and the bases of the reference that each record covers."""
    words = numbers(data, _flat(starts, counts * 4)[::4], "<u4")
    code, n = words & 15, (words >> 4).astype(np.int32)
    names = np.frombuffer(CIGAR_OPS, np.uint8)
    if len(code) and code.max() >= len(names):
        raise ValueError("unknown CIGAR operation")
    ops = pa.StringArray.from_buffers(len(code), pa.py_buffer(np.arange(len(code) + 1, dtype=np.int32)), pa.py_buffer(names[code]))
    offsets = np.concatenate([[0], np.cumsum(counts)])
    covered = np.concatenate([[0], np.cumsum(np.where(_CONSUMES[code], n, 0), dtype=np.int64)])
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([ops, pa.array(n)], names=["op", "n"]))
    return lists, covered[offsets[1:]] - covered[offsets[:-1]]


def tags(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Read group and alignment score: every round takes one tag of every record that has more."""
    n = len(starts)
    rg_at, rg_size, has_rg = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
    score, has_score = np.zeros(n, np.int32), np.zeros(n, bool)
    zeros = np.flatnonzero(data == 0)
    row, at = np.arange(n), starts.copy()
    while True:
        on = at + 3 <= ends[row]
        row, at = row[on], at[on]
        if not len(row):
            break
        name = data[at].astype(np.int64) << 8 | data[at + 1]
        kind = data[at + 2]
        value = at + 3
        size = _SIZES[kind]
        text = (kind == ord("Z")) | (kind == ord("H"))
        stop = zeros[np.minimum(np.searchsorted(zeros, value[text]), len(zeros) - 1)] if text.any() else value[:0]
        size[text] = stop + 1 - value[text]
        array = kind == ord("B")
        if array.any():
            size[array] = 5 + _SIZES[data[value[array]]] * numbers(data, value[array] + 1, "<i4")
        if (size <= 0).any():
            raise ValueError("unknown tag type")
        group = text & (name == (ord("R") << 8 | ord("G")))
        rg_at[row[group]], rg_size[row[group]], has_rg[row[group]] = value[group], size[group] - 1, True
        scored = name == (ord("A") << 8 | ord("S"))
        for letter, width in TAG_INTS.items():
            mine = scored & (kind == ord(letter))
            if mine.any():
                score[row[mine]], has_score[row[mine]] = numbers(data, value[mine], width), True
        at = value + size
    return strings(data, rg_at, rg_size, has_rg), pa.array(score, pa.int32(), mask=~has_score)


def decode(path: str, raw: bytes, starts: np.ndarray, contigs: pa.Array, wanted) -> pa.RecordBatch:
    """One batch from the records at ``starts``. ``wanted`` (heads, covered bases or None) says which ones are kept."""
    data = np.frombuffer(raw, np.uint8)
    head = np.ascontiguousarray(data[starts[:, None] + np.arange(HEAD.itemsize)]).view(HEAD).ravel()
    keep = wanted(head, None)
    if keep is not None:
        starts, head = starts[keep], head[keep]
    ops_at = starts + HEAD.itemsize + head["l_name"]
    n_ops = head["n_cigar"].astype(np.int64)
    ops, covered = cigars(data, ops_at, n_ops)
    keep = wanted(head, covered)
    if keep is not None and not keep.all():
        starts, head, ops_at, n_ops = starts[keep], head[keep], ops_at[keep], n_ops[keep]
        ops = ops.filter(pa.array(keep))
    l_seq = head["l_seq"].astype(np.int64)
    rg, score = tags(data, ops_at + 4 * n_ops + (l_seq + 1) // 2 + l_seq, starts + 4 + head["size"])
    name_of = lambda ref: contigs.take(pa.array(ref, pa.int32(), mask=ref < 0))
    whole = lambda field: pa.array(head[field].astype(np.int32))
    columns = [
        pa.array([path], pa.string()).take(pa.array(np.zeros(len(head), np.int32))), name_of(head["ref"]), whole("pos"), whole("mapq"),
        whole("flag"), whole("l_seq"), name_of(head["mate_ref"]), whole("mate_pos"), whole("tlen"), ops,
        strings(data, starts + HEAD.itemsize, head["l_name"].astype(np.int64) - 1), rg, score,
    ]
    return pa.RecordBatch.from_arrays(columns, schema=ARROW)
