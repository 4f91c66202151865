"""Indexes of sorted alignment files (BAI and CSI): which virtual offsets hold the records that may overlap a region."""

from __future__ import annotations

import io
import struct
from dataclasses import dataclass, field

from spanloom.sources import bgzf

#: Bits of a position within a smallest bin, and levels of bins above it in a BAI file; each level's bins are 8 times as long.
MIN_SHIFT, DEPTH = 14, 5

Span = tuple[int, int]


def first_bin(level: int) -> int:
    """Number of a level's first bin; level 0 is one bin over everything."""
    return ((1 << 3 * level) - 1) // 7


def bin_of(start: int, end: int, depth: int = DEPTH, min_shift: int = MIN_SHIFT) -> int:
    """The smallest bin that holds the whole interval."""
    for level in range(depth, 0, -1):
        shift = min_shift + 3 * (depth - level)
        if start >> shift == (end - 1) >> shift:
            return first_bin(level) + (start >> shift)
    return 0


def bin_span(number: int, depth: int = DEPTH, min_shift: int = MIN_SHIFT) -> Span:
    """The positions of a bin."""
    level = max(x for x in range(depth + 1) if first_bin(x) <= number)
    shift = min_shift + 3 * (depth - level)
    at = number - first_bin(level)
    return at << shift, (at + 1) << shift


@dataclass
class ContigIndex:
    """bins: spans of records by bin; windows: the least offset of a record in each stretch of 2**MIN_SHIFT positions."""

    bins: dict[int, list[Span]] = field(default_factory=dict)
    windows: dict[int, int] = field(default_factory=dict)
    mapped: int = 0
    unmapped: int = 0

    def add(self, number: int, start: int, end: int, begins: int, ends: int, mapped: bool) -> None:
        spans = self.bins.setdefault(number, [])
        if spans and spans[-1][1] == begins:
            spans[-1] = (spans[-1][0], ends)
        else:
            spans.append((begins, ends))
        for w in range(start >> MIN_SHIFT, ((end - 1) >> MIN_SHIFT) + 1):
            self.windows.setdefault(w, begins)
        self.mapped, self.unmapped = self.mapped + mapped, self.unmapped + (not mapped)

    def filled(self) -> list[int]:
        """windows as a list; one without records takes the one before, from which no later record is missed."""
        out = [0] * (max(self.windows, default=-1) + 1)
        for w in range(len(out)):
            out[w] = self.windows.get(w, out[w - 1] if w else 0)
        return out


class Index:
    """A file's index. spans() says where the records lie that may overlap intervals of a contig."""

    def __init__(self, contigs: list[ContigIndex], depth: int = DEPTH, min_shift: int = MIN_SHIFT, unplaced: int = 0):
        self.contigs, self.depth, self.min_shift, self.unplaced = contigs, depth, min_shift, unplaced

    def spans(self, contig: int, intervals: list[Span]) -> list[Span]:
        """Sorted spans without overlaps. What ends before the first record of an interval's first window is left out."""
        if contig >= len(self.contigs):
            return []
        held = self.contigs[contig]
        found = []
        placed = [(*bin_span(b, self.depth, self.min_shift), spans) for b, spans in held.bins.items()]
        for start, end in intervals:
            least = max((x for w, x in held.windows.items() if w <= start >> MIN_SHIFT), default=0) if held.windows else 0
            found += [(max(b, least), e) for lo, hi, spans in placed if lo < end and hi > start for b, e in spans if e > least]
        return merged(found)

    def starts(self, contig: int) -> list[int]:
        """Offsets at which records begin, in order: where a contig's spans may be cut."""
        held = self.contigs[contig]
        return sorted({b for spans in held.bins.values() for b, _ in spans} | {x for x in held.windows.values() if x})


def merged(spans: list[Span]) -> list[Span]:
    """The union of intervals, as sorted ones that neither overlap nor touch."""
    out: list[Span] = []
    for b, e in sorted(spans):
        if out and b <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((b, e))
    return out


def depth_for(longest: int) -> int:
    """Levels of bins that a contig of this length needs."""
    depth = DEPTH
    while longest > 1 << (MIN_SHIFT + 3 * depth):
        depth += 1
    return depth


def dump(index: Index) -> bytes:
    """The index as a file: BAI at its depth, CSI beyond. The bin past the last has a contig's extent and counts, as usual."""
    csi = index.depth != DEPTH
    out = [b"CSI\1" + struct.pack("<iii", MIN_SHIFT, index.depth, 0) if csi else b"BAI\1", struct.pack("<i", len(index.contigs))]
    for c in index.contigs:
        windows = c.filled()
        rows = sorted(c.bins.items())
        if rows:
            extent = (min(s[0][0] for _, s in rows), max(s[-1][1] for _, s in rows))
            rows.append((first_bin(index.depth + 1) + 1, [extent, (c.mapped, c.unmapped)]))
        out.append(struct.pack("<i", len(rows)))
        for number, spans in rows:
            out.append(struct.pack("<I", number))
            if csi:
                real = number < first_bin(index.depth + 1)
                w = bin_span(number, index.depth)[0] >> MIN_SHIFT if real else len(windows)
                out.append(struct.pack("<Q", windows[w] if w < len(windows) else 0))
            out.append(struct.pack("<i", len(spans)) + b"".join(struct.pack("<QQ", *s) for s in spans))
        if not csi:
            out.append(struct.pack(f"<i{len(windows)}Q", len(windows), *windows))
    out.append(struct.pack("<Q", index.unplaced))
    data = b"".join(out)
    if not csi:
        return data
    held = io.BytesIO()
    writer = bgzf.Writer(held)
    writer.write(data)
    writer.close()
    return held.getvalue()


def load(data: bytes) -> Index:
    """Reads either kind."""
    if data[:2] == b"\x1f\x8b":
        data = b"".join(part for _, part in bgzf.blocks(io.BytesIO(data), 0))
    stream = io.BytesIO(data)
    take = lambda f: struct.unpack(f, stream.read(struct.calcsize(f)))
    magic = stream.read(4)
    if magic not in (b"BAI\1", b"CSI\1"):
        raise ValueError("neither a BAI nor a CSI file")
    csi = magic == b"CSI\1"
    min_shift, depth, extra = take("<iii") if csi else (MIN_SHIFT, DEPTH, 0)
    stream.read(extra)
    contigs = []
    for _ in range(take("<i")[0]):
        c = ContigIndex()
        for _ in range(take("<i")[0]):
            number = take("<I")[0]
            least = take("<Q")[0] if csi else 0
            n = take("<i")[0]
            flat = take(f"<{2 * n}Q")
            spans = list(zip(flat[::2], flat[1::2], strict=True))
            if number < first_bin(depth + 1):
                c.bins[number] = spans
                if csi and least and min_shift >= MIN_SHIFT:
                    w = bin_span(number, depth, min_shift)[0] >> MIN_SHIFT
                    c.windows[w] = min(least, c.windows.get(w, least))
            elif n == 2:
                c.mapped, c.unmapped = spans[1]
        if not csi:
            n = take("<i")[0]
            c.windows = {w: x for w, x in enumerate(take(f"<{n}Q")) if x}
        contigs.append(c)
    rest = stream.read(8)
    return Index(contigs, depth, min_shift, int.from_bytes(rest, "little") if len(rest) == 8 else 0)
