"""Placing assembled sequences on the reference: where a sequence leaves it, where it comes back, and what lies between.

One sequence and the stretch of reference around its cluster pair are a group's, bounded by the cluster's reads and reach.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spanloom.functions.align import PADDING, TO_BASE, Scoring, align_many, column_bests, encode, together
from spanloom.operators.assembly import assemble
from spanloom.operators.grouped import fold_groups

_PAD = "N" * PADDING
#: What becomes of a cluster pair's assembly.
STATUSES = ("OK", "NO_SEQUENCE", "TOO_MANY_READS", "HAS_CYCLE", "BAD_ANCHORS", "HAS_N", "MICROHOMOLOGY_TOO_LONG", "TOO_SHORT")
#: Fixed value: the longest microhomology.
MOST_MICROHOMOLOGY = 100


@dataclass(frozen=True)
class Placed:
    """start and end: the last base before the insertion and the last one before what follows it, 0-based; anchors: inclusive."""

    start: int
    end: int
    seq: str
    left_anchor: tuple[int, int]
    right_anchor: tuple[int, int]
    left_cigar: str
    right_cigar: str
    left_good: bool
    right_good: bool


@dataclass(frozen=True)
class _Reach:
    """What the beginnings of a sequence earn on the reference: for each base of it the best score of those that end at or before it,
    how many letters that beginning has, and the base where it ends."""

    score: np.ndarray
    letters: np.ndarray
    base: np.ndarray


def _beginnings(seqs: list[np.ndarray], refs: list[np.ndarray], s: Scoring = TO_BASE) -> list[_Reach]:
    """Each beginning is aligned from its first letter on, wherever on the reference; of equal scores the shorter, then the earlier."""
    out: list[_Reach | None] = [None] * len(seqs)
    for some in together([(len(x), len(r)) for x, r in zip(seqs, refs, strict=True)]):
        best, letters = column_bests([seqs[i] for i in some], [refs[i] for i in some], s, False)
        top = np.maximum.accumulate(best, axis=1)
        rises = np.ones(top.shape, dtype=bool)
        rises[:, 1:] = top[:, 1:] > top[:, :-1]
        base = np.maximum.accumulate(np.where(rises & (best == top), np.arange(top.shape[1]), 0), axis=1)
        letters = np.take_along_axis(letters, base, 1)
        for k, i in enumerate(some):
            m = len(refs[i])
            out[i] = _Reach(top[k, :m], letters[k, :m], base[k, :m])
    return out


def _cuts(pairs: list[tuple[str, str, str]]) -> list[tuple[int, int, int]]:
    """For each (left, right, ref) where to cut the reference so that a beginning of `left` before it and an ending of `right` after it
    earn most, the first of equals: the last base before the cut, and how many letters of left and right these are."""
    refs = [encode(r) for _, _, r in pairs]
    reach = _beginnings([encode(x) for x, _, _ in pairs] + [encode(y)[::-1] for _, y, _ in pairs], refs + [r[::-1] for r in refs])
    out = []
    for before, after, r in zip(reach[: len(pairs)], reach[len(pairs) :], refs, strict=True):
        at = int((before.score[:-1].astype(np.int32) + after.score[::-1][1:]).argmax())
        out.append((at, int(before.letters[at]), int(after.letters[len(r) - 2 - at])))
    return out


def _placed(pairs: list[tuple[str, str, str]], least_clip: int) -> list[Placed | None]:
    """For each (left, right, ref) the left sequence's beginning and the right one's ending on both sides of the best cut; they are one
    sequence, or two whose other ends are open."""
    out: list[Placed | None] = [None] * len(pairs)
    kept = [i for i, (_, _, ref) in enumerate(pairs) if len(ref) >= 2]
    cuts = []
    for i, (at, n, k) in zip(kept, _cuts([(_PAD + pairs[i][0], pairs[i][1] + _PAD, pairs[i][2]) for i in kept]), strict=True):
        left, right, _ = pairs[i]
        n, k = max(n - PADDING, 0), max(k - PADDING, 0)
        if left is right:
            k = min(k, len(left) - n)  # no letter counts on both sides
        cuts.append((i, at, n, k))
    befores = align_many([_PAD + pairs[i][0][:n] for i, _, n, _ in cuts], [pairs[i][2][: at + 1] for i, at, _, _ in cuts], TO_BASE)
    afters = align_many([pairs[i][1][len(pairs[i][1]) - k :] + _PAD for i, _, _, k in cuts], [pairs[i][2][at + 1 :] for i, at, _, _ in cuts], TO_BASE)
    for (i, at, _, k), a, b in zip(cuts, befores, afters, strict=True):
        left, right, _ = pairs[i]
        if a is None or b is None:
            continue
        low = at + 1 + b.ref_begin
        high = at + 1 + b.ref_end
        held = max(a.query_end + 1 - PADDING, 0), k - b.query_begin  # letters of the sequences that the anchors hold
        seq = left[held[0] : len(left) - held[1]] if left is right else f"{left[held[0] :]}-{right[: len(right) - held[1]]}"
        good = a.query_begin == 0 and held[0] >= least_clip, b.query_end == k + PADDING - 1 and held[1] >= least_clip
        out[i] = Placed(a.ref_end, low - 1, seq, (a.ref_begin + PADDING, a.ref_end), (low, high - PADDING), a.cigar, b.cigar, *good)
    return out


def place(contigs: list[str], ref: str, least_clip: int = 15) -> Placed | None:
    """Where the first sequence leaves the reference and comes back. If it is anchored at one end only, the second sequence may be
    the other half, which has a clip's letters beyond its anchor at least; then a `-` stands for what is missing between them. None
    if nothing aligns."""
    return place_many([(contigs, ref)], least_clip)[0]


def place_many(cases: list[tuple[list[str], str]], least_clip: int = 15) -> list[Placed | None]:
    """place() of each case, many at a time."""
    out: list[Placed | None] = [None] * len(cases)
    kept = [i for i, (contigs, ref) in enumerate(cases) if contigs and contigs[0] and ref]
    for i, whole in zip(kept, _placed([(cases[i][0][0], cases[i][0][0], cases[i][1]) for i in kept], least_clip), strict=True):
        out[i] = whole
    half = [i for i in kept if out[i] is not None and out[i].left_good != out[i].right_good and len(cases[i][0]) > 1 and cases[i][0][1]]
    pairs = [((c[0], c[1]) if out[i].left_good else (c[1], c[0])) + (cases[i][1],) for i in half for c in (cases[i][0],)]
    for i, halves in zip(half, _placed(pairs, least_clip), strict=True):
        if halves is not None:
            piece = halves.seq.split("-")[out[i].left_good]
            if halves.left_good and halves.right_good and len(piece) >= least_clip:
                out[i] = halves
    return out


def judge(placed: Placed | None, ref: str, least_insertion: int = 50) -> tuple[str, Placed | None]:
    """The status, and the call with a microhomology folded into its sequence."""
    if placed is None or not (placed.left_good and placed.right_good):
        return "BAD_ANCHORS", None
    seq, end = placed.seq, placed.end
    if placed.start > placed.end:
        if placed.start - placed.end > MOST_MICROHOMOLOGY:
            return "MICROHOMOLOGY_TOO_LONG", None
        seq, end = ref[placed.end + 1 : placed.start + 1].upper() + seq, placed.start
    if "N" in seq:
        return "HAS_N", None
    if len(seq) < least_insertion:
        return "TOO_SHORT", None
    return "OK", Placed(placed.start, end, seq, placed.left_anchor, placed.right_anchor, placed.left_cigar, placed.right_cigar, True, True)


_SCHEMA = "status string, contig string, start long, end long, seq string, left_anchor string, right_anchor string, left_anchor_cigar string, right_anchor_cigar string, contigs int"


def assembled_insertions(reads: DataFrame, group: str, order: list[str], least: int, read_len: int, least_insertion: int = 50) -> DataFrame:
    """A row for each group, what became of its assembly, and the insertion if there is one.

    reads: group, seq, layer (1 to 3), order, contig and low, the same in all rows of a group, and ref, the stretch of reference around
    it, which begins at low; one row of a group that has it is enough. Groups are bounded (see assembly.MOST_READS) and streamed."""
    kind = reads.schema[group].dataType.simpleString()

    def fold(rows: list[dict]) -> list[tuple]:
        head, ref = rows[0], next((r["ref"] for r in rows if r["ref"] is not None), "")
        status, contigs = assemble([(r["seq"], r["layer"], True, True) for r in rows], least, read_len)
        call = None
        if status == "OK" and not contigs:
            status = "NO_SEQUENCE"
        if status == "OK":
            status, call = judge(place(contigs, ref, least), ref, least_insertion)
        if call is None:
            return [(head[group], status, head["contig"], *[None] * 7, len(contigs))]
        low, spans = head["low"], lambda x: f"{head['low'] + x[0]}-{head['low'] + x[1]}"
        return [(head[group], status, head["contig"], low + call.start, low + call.end, call.seq, spans(call.left_anchor), spans(call.right_anchor), call.left_cigar, call.right_cigar, len(contigs))]

    return fold_groups(reads.select(group, "seq", "layer", "contig", "ref", "low", *order), [group], order, fold, f"`{group}` {kind}, {_SCHEMA}")


def place_sequences(df: DataFrame, seqs: str, ref: str, least_clip: int = 15, least_insertion: int = 50) -> DataFrame:
    """Adds status, start, end, seq, the anchors (a-b) and their CIGARs of the insertion that the row's assembled sequences (an array, the best first) make in its
    stretch of reference; null and empty ones are BAD_ANCHORS."""
    names = df.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(s or [], r or "") for s, r in zip(batch.column(names.index(seqs)).to_pylist(), batch.column(names.index(ref)).to_pylist(), strict=True)]
            found = [judge(p, r, least_insertion) for p, (_, r) in zip(place_many(pairs, least_clip), pairs, strict=True)]
            calls = [c for _, c in found]
            texts = {"seq": [c and c.seq for c in calls], "left_anchor": [c and f"{c.left_anchor[0]}-{c.left_anchor[1]}" for c in calls], "right_anchor": [c and f"{c.right_anchor[0]}-{c.right_anchor[1]}" for c in calls]}
            texts |= {"left_anchor_cigar": [c and c.left_cigar for c in calls], "right_anchor_cigar": [c and c.right_cigar for c in calls]}
            columns = [pa.array([s for s, _ in found], pa.string()), *[pa.array([c and getattr(c, n) for c in calls], pa.int64()) for n in ("start", "end")], *[pa.array(t, pa.string()) for t in texts.values()]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*names, "status", "start", "end", *texts])

    return df.mapInArrow(run, f"{fields}, status string, start long, end long, seq string, left_anchor string, right_anchor string, left_anchor_cigar string, right_anchor_cigar string")
