"""BAM files and their indices for tests, and a plain decoder that reads one field after the other."""

from __future__ import annotations

import gzip
import random
import struct
import zlib

OPS = "MIDNSHP=X"


def block(data: bytes) -> bytes:
    c = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def record(name: str, ref: int, pos: int, flag: int = 99, cigar=(("S", 10), ("M", 90)), mate=None, tlen: int = 350, mapq: int = 60, tags: bytes = b"", l_seq: int = 100) -> bytes:
    ops = b"".join(struct.pack("<I", n << 4 | OPS.index(op)) for op, n in cigar)
    mate_ref, mate_pos = mate if mate is not None else (ref, pos + 250)
    named = name.encode() + b"\0"
    body = struct.pack("<iiBBHHHiiii", ref, pos, len(named), mapq, 0, len(cigar), flag, l_seq, mate_ref, mate_pos, tlen)
    body += named + ops + b"\x11" * ((l_seq + 1) // 2) + b"\xff" * l_seq + tags
    return struct.pack("<i", len(body)) + body


def group(rg: str | None, score: int | None = None, kind: str = "i") -> bytes:
    out = b"NMC\x03"
    if rg is not None:
        out += b"RGZ" + rg.encode() + b"\0"
    out += b"XBBs\x02\0\0\0\1\0\2\0" + b"MDZ100\0" + b"XFf" + struct.pack("<f", 0.5) + b"XAA!"
    if score is not None:
        out += b"AS" + kind.encode() + struct.pack({"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I"}[kind], score)
    return out


def random_records(n: int, lengths: list[int], seed: int = 1) -> list[bytes]:
    """Records sorted by place, with odd names, operations, tags, and some that lie nowhere at the end."""
    rng = random.Random(seed)
    places = sorted((rng.randrange(len(lengths)), rng.randrange(max(lengths))) for _ in range(n))
    places = [(r, p % lengths[r]) for r, p in places]
    out = []
    for k, (ref, pos) in enumerate(sorted(places)):
        cigar = [("M", 100)] if k % 3 else [("S", 5), ("M", 40), ("D", rng.randrange(1, 30_000 if k % 50 == 0 else 9)), ("I", 2), ("N", 1), ("=", 30), ("X", 23), ("H", 2)]
        tags = [b"", group(f"g{k % 3}", k % 120, "cCsSiI"[k % 6]), group(None, -5, "c"), group("a long read group name")][k % 4]
        mate = (-1, -1) if k % 7 == 0 else (rng.randrange(len(lengths)), rng.randrange(1000))
        out.append(record(f"q{k}" * (1 + k % 4), ref, pos, k % 4096, cigar if k % 11 else [], mate, rng.randrange(-500, 500), k % 61, tags, rng.choice([0, 1, 75, 100])))
    return out + [record(f"nowhere{k}", -1, -1, 4, (), (-1, -1), 0) for k in range(5)]


def covered(body: bytes) -> int:
    n_name, n_ops = body[12], struct.unpack_from("<H", body, 16)[0]
    words = struct.unpack_from(f"<{n_ops}I", body, 36 + n_name)
    return max(1, sum(w >> 4 for w in words if OPS[w & 15] in "MDN=X"))


def _bin(beg: int, end: int) -> int:
    """The smallest bin that holds [beg, end)."""
    for level in range(5, -1, -1):
        shift = 14 + 3 * (5 - level)
        if beg >> shift == (end - 1) >> shift:
            return (8**level - 1) // 7 + (beg >> shift)
    raise AssertionError


def write_bam(path: str, records: list[bytes], contigs: list[tuple[str, int]], text: bytes = b"@HD\tVN:1.6\n", block_size: int = 3000) -> None:
    head = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(contigs))
    for name, length in contigs:
        head += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", length)
    out = bytearray(block(head))
    bins: list[dict[int, list[list[int]]]] = [{} for _ in contigs]
    linear: list[dict[int, int]] = [{} for _ in contigs]
    pending, places = b"", []
    for r in records:
        places.append(len(out) << 16 | len(pending))
        pending += r
        while len(pending) >= block_size:
            out += block(pending[:block_size])  # in the middle of a record, as writers do
            pending = pending[block_size:]
    out += block(pending)
    places.append(len(out) << 16)
    out += block(b"")
    for r, begin, end in zip(records, places[:-1], places[1:], strict=True):
        ref, pos = struct.unpack_from("<ii", r, 4)
        if ref < 0:
            continue
        last = pos + covered(r)
        spans = bins[ref].setdefault(_bin(pos, last), [])
        if spans and spans[-1][1] == begin:
            spans[-1][1] = end
        else:
            spans.append([begin, end])
        for w in range(pos >> 14, (last - 1 >> 14) + 1):
            linear[ref].setdefault(w, begin)
    with open(path, "wb") as f:
        f.write(out)
    index = b"BAI\1" + struct.pack("<i", len(contigs))
    for mine, windows in zip(bins, linear, strict=True):
        index += struct.pack("<i", len(mine) + 1)
        for number, spans in mine.items():
            index += struct.pack("<Ii", number, len(spans)) + b"".join(struct.pack("<QQ", *s) for s in spans)
        index += struct.pack("<Ii", 37450, 2) + struct.pack("<4Q", 1, 2, 3, 4)
        slots = [windows.get(k, 0) for k in range(max(windows, default=-1) + 1)]
        index += struct.pack("<i", len(slots)) + struct.pack(f"<{len(slots)}Q", *slots)
    with open(path + ".bai", "wb") as f:
        f.write(index)


def plain_rows(path: str) -> list[tuple]:
    """All records of a file, one field after the other."""
    with open(path, "rb") as f:
        data = gzip.decompress(f.read())
    at = 8 + struct.unpack_from("<i", data, 4)[0]
    contigs = []
    n, at = struct.unpack_from("<i", data, at)[0], at + 4
    for _ in range(n):
        size = struct.unpack_from("<i", data, at)[0]
        contigs.append(data[at + 4 : at + 3 + size].decode())
        at += 8 + size
    rows = []
    while at < len(data):
        size = struct.unpack_from("<i", data, at)[0]
        rows.append(plain_row(data[at + 4 : at + 4 + size], contigs))
        at += 4 + size
    return rows


def plain_row(body: bytes, contigs: list[str]) -> tuple:
    ref, pos, n_name, mapq, _, n_ops, flag, l_seq, mate_ref, mate_pos, tlen = struct.unpack_from("<iiBBHHHiiii", body, 0)
    at = 32 + n_name
    cigar = [(OPS[w & 15], w >> 4) for w in struct.unpack_from(f"<{n_ops}I", body, at)]
    at += 4 * n_ops + (l_seq + 1) // 2 + l_seq
    rg = score = None
    sizes = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
    while at < len(body):
        tag, kind, at = body[at : at + 2], chr(body[at + 2]), at + 3
        if kind in "ZH":
            stop = body.index(b"\0", at)
            rg = body[at:stop].decode() if tag == b"RG" else rg
            at = stop + 1
        elif kind == "B":
            at += 5 + sizes[chr(body[at])] * struct.unpack_from("<i", body, at + 1)[0]
        else:
            if tag == b"AS":
                score = struct.unpack_from({"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I"}[kind], body, at)[0]
            at += sizes[kind]
    name = lambda i: contigs[i] if i >= 0 else None
    return name(ref), pos, mapq, flag, l_seq, name(mate_ref), mate_pos, tlen, cigar, body[32 : 32 + n_name - 1].decode(), rg, score
