"""From positions to places in a BAM file: the index's hierarchical bins and its linear part.

Virtual offsets name a place: start of the compressed block << 16 | offset inside its content.
"""

from __future__ import annotations

import struct
from bisect import bisect_right
from collections.abc import Iterable
from dataclasses import dataclass, field

# Fixed values of the index format: levels of bins, each 8 times as fine as the one above, down to windows of 2^14 bases.
LEVELS, FINEST_SHIFT = 6, 14
#: Spans closer than this many compressed bytes are read as one.
NEAR = 1 << 16
END = 1 << 62


@dataclass
class ContigIndex:
    #: per bin, the spans of the file that hold its records
    bins: dict[int, list[tuple[int, int]]] = field(default_factory=dict)
    #: per window, the first record that overlaps it; zero where there is none
    linear: list[int] = field(default_factory=list)

    def starts(self) -> list[int]:
        """All places known to begin a record, ascending."""
        return sorted({x for x in self.linear if x} | {b for spans in self.bins.values() for b, e in spans if b < e})


def parse_index(data: bytes) -> list[ContigIndex]:
    if data[:4] != b"BAI\x01":
        raise ValueError("not an index of a BAM file")
    at, out = 8, []
    for _ in range(struct.unpack_from("<i", data, 4)[0]):
        one = ContigIndex()
        n_bins = struct.unpack_from("<i", data, at)[0]
        at += 4
        for _ in range(n_bins):
            number, n = struct.unpack_from("<Ii", data, at)
            flat = struct.unpack_from(f"<{2 * n}Q", data, at + 8)
            if number < sum(8**k for k in range(LEVELS)):  # larger numbers hold counts, not records
                one.bins[number] = list(zip(flat[::2], flat[1::2], strict=True))
            at += 8 + 16 * n
        n = struct.unpack_from("<i", data, at)[0]
        one.linear = list(struct.unpack_from(f"<{n}Q", data, at + 4))
        at += 4 + 8 * n
        out.append(one)
    return out


def bins_over(beg: int, end: int) -> Iterable[range]:
    """Numbers of the bins of every level that records overlapping [beg, end) may be filed under."""
    for level in range(LEVELS):
        shift = FINEST_SHIFT + 3 * (LEVELS - 1 - level)
        first = sum(8**k for k in range(level))
        yield range(first + (beg >> shift), first + (max(beg, end - 1) >> shift) + 1)


def spans_over(index: ContigIndex, regions: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans of the file, ascending, with every record that overlaps one of the regions."""
    found = []
    for beg, end in regions:
        window = beg >> FINEST_SHIFT
        least = max(index.linear[: window + 1], default=0)
        for numbers in bins_over(beg, end):
            present = numbers if len(numbers) < len(index.bins) else [n for n in index.bins if n in numbers]
            for n in present:
                found += [(max(b, least), e) for b, e in index.bins.get(n, ()) if e > least]
    return joined(found)


def joined(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for b, e in sorted(x for x in spans if x[0] < x[1]):
        if out and (b >> 16) <= (out[-1][1] >> 16) + NEAR:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((b, e))
    return out


def pieces(spans: Iterable[tuple[int, int]], starts: list[int], range_bytes: int) -> list[tuple[int, int]]:
    """Spans cut at known record starts, so that a piece has at least ``range_bytes`` compressed bytes where it can."""
    out = []
    for begin, end in spans:
        at = begin
        for cut in starts[bisect_right(starts, begin) :]:
            if cut >= end:
                break
            if (cut >> 16) - (at >> 16) >= range_bytes:
                out.append((at, cut))
                at = cut
        out.append((at, end))
    return out
