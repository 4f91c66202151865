"""Alignment kernels: ungapped suffix-prefix overlaps and local alignment with affine gaps, row by row in NumPy.

A gap of length k costs gap_open + (k - 1) * gap_extend, and gap_open must not be less than gap_extend. Letters compare
without case; what is not A, C, G or T counts as N.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_CODES = np.full(256, 4, dtype=np.int8)
for _i, _b in enumerate("ACGT"):
    _CODES[ord(_b)] = _CODES[ord(_b.lower())] = _i
_NONE = -(1 << 28)


@dataclass(frozen=True)
class Scoring:
    match: int
    mismatch: int
    gap_open: int
    gap_extend: int
    n_matches: bool = False

    def rows(self, reference: np.ndarray) -> np.ndarray:
        """Scores of each letter against the reference: five rows."""
        out = np.full((5, len(reference)), -self.mismatch, dtype=np.int32)
        for c in range(4):
            out[c][reference == c] = self.match
        if self.n_matches:
            out[4] = self.match
            out[:, reference == 4] = self.match
        return out


#: The presets.
DEFAULT = Scoring(1, 4, 6, 1)
PERMISSIVE = Scoring(2, 2, 4, 1)
TO_BASE = Scoring(1, 4, 6, 1, True)
HARSH = Scoring(1, 4, 100, 1, True)
#: Letters N that pad a query so that ends are rewarded where N matches.
PADDING = 7


@dataclass(frozen=True)
class Alignment:
    """Inclusive 0-based ends. The CIGAR has =, X, I, D and S; mismatches count X, I and D letters."""

    score: int
    ref_begin: int
    ref_end: int
    query_begin: int
    query_end: int
    mismatches: int
    cigar: str


def letter_codes(ascii_letters: np.ndarray) -> np.ndarray:
    return _CODES[ascii_letters]


def encode(seq: str) -> np.ndarray:
    return letter_codes(np.frombuffer(seq.encode("ascii", "replace"), dtype=np.uint8))


def _best(query: np.ndarray, reference: np.ndarray, s: Scoring) -> tuple[int, int, int]:
    """Best local score and its end (query, reference): the first reference place that has it, there the first query place."""
    rows = s.rows(reference)
    m = len(reference)
    h, f = np.zeros(m + 1, dtype=np.int32), np.full(m + 1, _NONE, dtype=np.int32)
    ramp = np.arange(m + 1, dtype=np.int32) * s.gap_extend
    best = (0, -1, -1)
    for i, c in enumerate(query.tolist()):
        f = np.maximum(f - s.gap_extend, h - s.gap_open)
        new = np.zeros(m + 1, dtype=np.int32)
        np.maximum(h[:-1] + rows[c], 0, out=new[1:])
        np.maximum(new, f, out=new)
        new[0] = 0
        reach = np.maximum.accumulate(new + ramp)  # a gap along the reference opens at the best place so far
        np.maximum(new[1:], reach[:-1] - ramp[:-1] - s.gap_open, out=new[1:])
        h = new
        top = int(h.max())
        j = int(h.argmax()) - 1
        if top > best[0] or top == best[0] and top > 0 and j < best[2]:
            best = (top, i, j)
    return best


def _trace(query: np.ndarray, reference: np.ndarray, s: Scoring) -> str:
    """Operations of the best end-to-end alignment: diagonal before gaps, deletion before insertion, extension before opening."""
    n, m = len(query), len(reference)
    rows = s.rows(reference)
    h = np.full((n + 1, m + 1), _NONE, dtype=np.int32)
    e, f = h.copy(), h.copy()  # e: ends in a deletion (along the reference); f: in an insertion
    h[0, 0] = 0
    ramp = np.arange(m + 1, dtype=np.int32) * s.gap_extend
    for i in range(n + 1):
        if i:
            f[i] = np.maximum(f[i - 1] - s.gap_extend, h[i - 1] - s.gap_open)
            h[i, 1:] = h[i - 1, :-1] + rows[query[i - 1]]
            np.maximum(h[i], f[i], out=h[i])
        reach = np.maximum.accumulate(h[i] + ramp)
        e[i, 1:] = reach[:-1] - ramp[:-1] - s.gap_open
        np.maximum(h[i], e[i], out=h[i])
    out, i, j, state = [], n, m, "H"
    while i or j:
        if state == "H":
            if i and j and h[i, j] == h[i - 1, j - 1] + rows[query[i - 1], j - 1]:
                out.append("=" if query[i - 1] == reference[j - 1] and query[i - 1] < 4 else "X")
                i, j = i - 1, j - 1
            else:
                state = "D" if j and h[i, j] == e[i, j] else "I"
        elif state == "D":
            out.append("D")
            state = "D" if j > 1 and e[i, j] == e[i, j - 1] - s.gap_extend else "H"
            j -= 1
        else:
            out.append("I")
            state = "I" if i > 1 and f[i, j] == f[i - 1, j] - s.gap_extend else "H"
            i -= 1
    return "".join(reversed(out))


def locate(query: str, reference: str, scoring: Scoring = DEFAULT) -> tuple[int, int, int, int, int] | None:
    """score, ref_begin, ref_end, query_begin and query_end of the best local alignment, as align() has it, without its operations."""
    q, r = encode(query), encode(reference)
    if not len(q) or not len(r):
        return None
    return _located(q, r, scoring, *_best(q, r, scoring))


def _located(q: np.ndarray, r: np.ndarray, s: Scoring, score: int, qe: int, re_: int) -> tuple[int, int, int, int, int] | None:
    """Finds where an alignment with this end begins, going backwards no further than its score can pay for gaps."""
    if score <= 0:
        return None
    longest = (qe + 1) * (1 + s.match // max(1, s.gap_extend)) + 1
    _, back_q, back_r = _best(q[qe::-1], r[max(0, re_ - longest) : re_ + 1][::-1], s)
    return score, re_ - back_r, re_, qe - back_q, qe


#: Cells of a row that several queries take together.
_CELLS = 1 << 15


def locate_many(queries: list[str], reference: str, scoring: Scoring = DEFAULT) -> list[tuple[int, int, int, int, int] | None]:
    """locate() of each query against one reference, several at a time."""
    r = encode(reference)
    codes = [encode(q) for q in queries]
    out: list[tuple[int, int, int, int, int] | None] = [None] * len(queries)
    order = [i for i in sorted(range(len(queries)), key=lambda i: -len(codes[i])) if len(codes[i]) and len(r)]
    step = max(1, _CELLS // (len(r) + 1))
    for k in range(0, len(order), step):
        some = order[k : k + step]
        for i, best in zip(some, _best_of_many([codes[i] for i in some], r, scoring), strict=True):
            out[i] = _located(codes[i], r, scoring, *best)
    return out


def _best_of_many(queries: list[np.ndarray], reference: np.ndarray, s: Scoring) -> list[tuple[int, int, int]]:
    """_best() of each query; the longest comes first."""
    rows, m = s.rows(reference), len(reference)
    sizes = np.array([len(q) for q in queries])
    padded = np.zeros((len(queries), sizes[0]), dtype=np.int8)
    for i, q in enumerate(queries):
        padded[i, : len(q)] = q
    h, f = np.zeros((len(queries), m + 1), dtype=np.int32), np.full((len(queries), m + 1), _NONE, dtype=np.int32)
    ramp = np.arange(m + 1, dtype=np.int32) * s.gap_extend
    best = np.zeros((len(queries), 3), dtype=np.int64)
    best[:, 1:] = -1
    for i in range(sizes[0]):
        n = int(np.searchsorted(-sizes, -i, "left"))  # queries of more than i letters
        h, f = h[:n], f[:n]
        f = np.maximum(f - s.gap_extend, h - s.gap_open)
        new = np.zeros((n, m + 1), dtype=np.int32)
        np.maximum(h[:, :-1] + rows[padded[:n, i]], 0, out=new[:, 1:])
        np.maximum(new, f, out=new)
        new[:, 0] = 0
        reach = np.maximum.accumulate(new + ramp, axis=1)
        np.maximum(new[:, 1:], reach[:, :-1] - ramp[:-1] - s.gap_open, out=new[:, 1:])
        h = new
        j = h.argmax(axis=1)
        top = h[np.arange(n), j]
        better = (top > best[:n, 0]) | (top == best[:n, 0]) & (top > 0) & (j - 1 < best[:n, 2])
        at = np.flatnonzero(better)
        best[at, 0], best[at, 1], best[at, 2] = top[at], i, j[at] - 1
    return [tuple(b) for b in best.tolist()]


#: Cells of a diagonal that several pairs take together.
_TOGETHER = 1 << 14
#: Each letter as a bit, so that letters match where they share one.
_BITS = np.array([1, 2, 4, 8, 0], dtype=np.int16)


def together(sizes: list[tuple[int, int]]) -> list[list[int]]:
    """Pairs of like sizes, some at a time."""
    order, out, k = sorted(range(len(sizes)), key=lambda i: (-max(sizes[i]), sizes[i])), [], 0
    while k < len(order):
        step = max(1, _TOGETHER // (max(sizes[order[k]]) + 1))
        out.append(order[k : k + step])
        k += step
    return out


def column_bests(queries: list[np.ndarray], references: list[np.ndarray], s: Scoring, local: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each pair and each base of its reference the best score (0 at least) of the alignments that end there, and of how many of the
    query's letters the shortest such one is an alignment; local ones begin anywhere in the query, others at its first letter.

    All pairs go along their diagonals together; a cell needs only the two diagonals before. What fills up shorter ones matches nothing,
    so it never has the best score of a pair."""
    size, n, m = len(queries), max(map(len, queries)), max(map(len, references))
    kind = np.int16 if (n + m + 2) * max(s.match, s.gap_extend) + 2 * s.gap_open + s.mismatch < 30000 else np.int32
    none = -30000 if kind is np.int16 else _NONE
    bits = _BITS.copy()
    bits[4] = 15 if s.n_matches else 0
    q, r = np.zeros((n, size), dtype=kind), np.zeros((m, size), dtype=kind)  # the reference backwards, as along a diagonal
    for b, (x, y) in enumerate(zip(queries, references, strict=True)):
        q[: len(x), b] = bits[x]
        r[m - len(y) :, b] = bits[y[::-1]]
    best, letters = np.zeros((m, size), dtype=kind), np.zeros((m, size), dtype=kind)
    h0, h1, h2 = (np.zeros((n + 1, size), dtype=kind) for _ in range(3))
    e0, e1, f0, f1 = (np.full((n + 1, size), none, dtype=kind) for _ in range(4))
    row = np.repeat(np.arange(n + 1, dtype=kind)[:, None], size, axis=1)
    room, same = np.empty((n + 1, size), dtype=kind), np.empty((n + 1, size), dtype=kind)
    if not local and n:
        h1[1] = -s.gap_open
    for d in range(2, n + m + 1):
        a, b = max(1, d - m), min(n, d - 1) + 1
        here, cut = slice(a, b), slice(m - d + a, m - d + b)
        up, t, z = slice(a - 1, b - 1), room[: b - a], same[: b - a]
        e, f, h = e0[here], f0[here], h0[here]
        np.subtract(h1[here], s.gap_open, out=t)
        np.subtract(e1[here], s.gap_extend, out=e)
        np.maximum(e, t, out=e)
        np.subtract(h1[up], s.gap_open, out=t)
        np.subtract(f1[up], s.gap_extend, out=f)
        np.maximum(f, t, out=f)
        np.bitwise_and(q[up], r[cut], out=z)
        np.minimum(z, 1, out=z)
        np.multiply(z, s.match + s.mismatch, out=t)
        np.add(h2[up], t, out=h)
        np.subtract(h, s.mismatch, out=h)
        np.maximum(h, e, out=h)
        np.maximum(h, f, out=h)
        if local:
            np.maximum(h, 0, out=h)
        more = h > best[cut]
        np.maximum(best[cut], h, out=best[cut])
        np.copyto(letters[cut], row[here], where=more)
        h0[0], e0[0], f0[0] = 0, none, none
        if d <= n:
            h0[d], e0[d], f0[d] = 0 if local else -(s.gap_open + (d - 1) * s.gap_extend), none, none
        h0, h1, h2, e0, e1, f0, f1 = h2, h0, h1, e1, e0, f1, f0
    return best[::-1].T, letters[::-1].T


#: Cells of a step that several queries without gaps take together.
_STEP = 1 << 17


def gaps_may_pay(n: int | np.ndarray | Column, s: Scoring) -> bool | np.ndarray | Column:
    """Whether an alignment of n letters may owe its score to a gap: both of its sides must earn more than the gap costs, else the
    better side alone has that score, and ends first or is shorter."""
    return n * s.match > 2 * s.gap_open + 1


def locate_ungapped(letters: np.ndarray, starts: np.ndarray, texts: np.ndarray, text_starts: np.ndarray, of: np.ndarray, s: Scoring, which: np.ndarray) -> np.ndarray:
    """locate() of these queries, for which no gap pays, in their texts; five numbers each, the first 0 where nothing aligns.

    letters, texts: codes, end to end; starts, text_starts: where each begins, and the end of all; of: each query's text."""
    sizes, text_sizes = np.diff(starts), np.diff(text_starts)
    out = np.zeros((len(sizes), 5), dtype=np.int64)
    bits = _BITS.astype(np.int8)
    bits[4] = 15 if s.n_matches else 0
    letters, texts = bits[letters], bits[texts]
    ready = which[(sizes[which] > 0) & (text_sizes[of[which]] > 0)]
    order, k = ready[np.lexsort((of[ready], -text_sizes[of[ready]]))], 0
    while k < len(order):
        some = order[k : k + max(1, _STEP // int(text_sizes[of[order[k]]]))]
        k += len(some)
        held, mine = np.unique(of[some], return_inverse=True)
        n, m = int(sizes[some].max()), int(text_sizes[held].max())
        kind = np.int8 if s.match * (n + 1) < 128 else np.int16 if s.match * (n + 1) < 1 << 15 else np.int32
        q = _columns(letters, starts, some, n, kind)
        r = np.zeros((m + 2 * n - 2, len(some)), dtype=kind)  # n - 1 places before and behind the text match nothing
        r[n - 1 : n - 1 + m] = _columns(texts, text_starts, held, m, kind)[:, mine]
        lost = min(s.mismatch, s.match * n)  # more than there can be is not lost
        best, h = np.zeros_like(r), np.zeros((m + n - 1, len(some)), dtype=kind)
        room, none, one = np.empty_like(h), np.zeros_like(h), np.ones_like(h)  # whole arrays, as NumPy is slow with one number here
        for i in range(n):
            here = slice(i, i + m + n - 1)
            _step(h, q[i], r[here], room, none, one, s.match, lost)
            np.maximum(best[here], h, out=best[here])
        top, at = best.max(axis=0), np.maximum(best.argmax(axis=0), n - 1)
        # Of the diagonals through the first place of the best score that which has it at the first letter of the query.
        r = r[at - (n - 1) + np.arange(n)[:, None], np.arange(len(some))]
        h, last = np.zeros_like(r), np.full(len(some), -1)
        for i in range(n):
            _step(h[: n - i], q[i], r[i:], room[: n - i], none[: n - i], one[: n - i], s.match, lost)
            last[(h[n - i - 1] == top) & (last < 0)] = i
        back = np.arange(n)[:, None]
        same = (q[np.maximum(last - back, 0), np.arange(len(some))] & r[::-1]) > 0
        earned = np.cumsum(np.where(same, s.match, -lost), axis=0)
        length = ((earned == top) & (back <= last)).argmax(axis=0)
        at -= n - 1
        out[some] = np.where(top > 0, [top, at - length, at, last - length, last], 0).T
    return out[which]


def _columns(letters: np.ndarray, starts: np.ndarray, some: np.ndarray, longest: int, kind: type) -> np.ndarray:
    """Texts as columns, filled up with 0."""
    place = np.arange(longest)[:, None]
    return np.where(place < starts[some + 1] - starts[some], letters[np.minimum(starts[some] + place, len(letters) - 1)], 0).astype(kind)


def _step(h: np.ndarray, q: np.ndarray, r: np.ndarray, room: np.ndarray, none: np.ndarray, one: np.ndarray, match: int, lost: int) -> None:
    """Goes on along the diagonals by one letter."""
    np.bitwise_and(r, q, out=room)
    np.minimum(room, one, out=room)
    np.multiply(room, match + lost, out=room)
    np.subtract(room, lost, out=room)
    np.add(h, room, out=h)
    np.maximum(h, none, out=h)


def _best_of_pairs(queries: list[np.ndarray], references: list[np.ndarray], s: Scoring) -> list[tuple[int, int, int]]:
    """_best() of each pair."""
    out: list[tuple[int, int, int]] = [(0, -1, -1)] * len(queries)
    for some in together([(len(q), len(r)) for q, r in zip(queries, references, strict=True)]):
        best, letters = column_bests([queries[i] for i in some], [references[i] for i in some], s, True)
        at = best.argmax(axis=1)
        for i, j, top, n in zip(some, at.tolist(), best[np.arange(len(some)), at].tolist(), letters[np.arange(len(some)), at].tolist(), strict=True):
            if top > 0:
                out[i] = (top, n - 1, j)
    return out


def align_many(queries: list[str], references: list[str], scoring: Scoring = DEFAULT) -> list[Alignment | None]:
    """align() of each pair, many at a time."""
    q, r = [encode(x) for x in queries], [encode(x) for x in references]
    out: list[Alignment | None] = [None] * len(q)
    ready = [i for i in range(len(q)) if len(q[i]) and len(r[i])]
    ends = dict(zip(ready, _best_of_pairs([q[i] for i in ready], [r[i] for i in ready], scoring), strict=True))
    ready = [i for i in ready if ends[i][0] > 0]
    longest = lambda qe: (qe + 1) * (1 + scoring.match // max(1, scoring.gap_extend)) + 1
    back = [(q[i][ends[i][1] :: -1], r[i][max(0, ends[i][2] - longest(ends[i][1])) : ends[i][2] + 1][::-1]) for i in ready]
    for i, (_, back_q, back_r) in zip(ready, _best_of_pairs([x for x, _ in back], [y for _, y in back], scoring), strict=True):
        score, qe, re_ = ends[i]
        out[i] = _spelt(q[i], r[i], score, re_ - back_r, re_, qe - back_q, qe, scoring)
    return out


def align(query: str, reference: str, scoring: Scoring = DEFAULT) -> Alignment | None:
    """The best local alignment; None if no letters match. Of equal ones that which ends first, and then is shortest, on the
    reference."""
    if (found := locate(query, reference, scoring)) is None:
        return None
    q, r = encode(query), encode(reference)
    return _spelt(q, r, *found, scoring)


def _spelt(q: np.ndarray, r: np.ndarray, score: int, rb: int, re_: int, qb: int, qe: int, s: Scoring) -> Alignment:
    """The alignment with these ends. Letters one by one go before gaps, so where they earn the score nothing is looked for."""
    x, y = q[qb : qe + 1], r[rb : re_ + 1]
    ops = ""
    if len(x) == len(y):
        same = x == y
        fits = same & (x < 4) | ((x == 4) | (y == 4)) if s.n_matches else same & (x < 4)
        if int(np.where(fits, s.match, -s.mismatch).sum()) == score:
            ops = "".join(np.where(same & (x < 4), "=", "X").tolist())
    ops = ops or _trace(x, y, s)
    runs, last = [], None
    for o in ops:
        if o == last:
            runs[-1][0] += 1
        else:
            runs.append([1, o])
            last = o
    cigar = (f"{qb}S" if qb else "") + "".join(f"{n}{o}" for n, o in runs) + (f"{len(q) - 1 - qe}S" if qe < len(q) - 1 else "")
    return Alignment(score, rb, re_, qb, qe, sum(o != "=" for o in ops), cigar)


def suffix_prefix(a: str, b: str, match: int = 1, mismatch: int = -4, error: float = 0.0, least: int = 1, most_mismatches: int | None = None) -> tuple[int, int, int] | None:
    """(overlap, score, mismatches) of the best ungapped overlap of a suffix of `a` with a prefix of `b`.

    score = match * (n - m) + mismatch * m, where m mismatches are allowed up to max(1, n * error), or none without error,
    and up to most_mismatches. Of equal scores the longer overlap wins. None if no overlap of `least` letters is allowed."""
    x, y = np.frombuffer(a.encode(), dtype=np.uint8), np.frombuffer(b.encode(), dtype=np.uint8)
    best: tuple[int, int, int] | None = None
    for n in range(min(len(x), len(y)), max(least, 1) - 1, -1):
        if best is not None and match * n <= best[1]:
            break  # no shorter overlap can score more
        m = int(np.count_nonzero(x[len(x) - n :] != y[:n]))
        allowed = max(1, int(n * error)) if error > 0 else 0
        if most_mismatches is not None:
            allowed = min(allowed, most_mismatches)
        score = match * (n - m) + mismatch * m
        if m <= allowed and (best is None or score > best[1]):
            best = (n, score, m)
    return best


def align_columns(query: Column, reference: Column, scoring: Scoring = DEFAULT) -> Column:
    """struct<score, ref_begin, ref_end, query_begin, query_end, mismatches, cigar>; null without an alignment."""
    fields = ("score", "ref_begin", "ref_end", "query_begin", "query_end", "mismatches", "cigar")

    @F.pandas_udf("score int, ref_begin int, ref_end int, query_begin int, query_end int, mismatches int, cigar string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for queries, references in batches:
            found = align_many([q if isinstance(q, str) else "" for q in queries], [r if isinstance(r, str) else "" for r in references], scoring)
            yield pd.DataFrame({f: pd.array([None if a is None else getattr(a, f) for a in found], dtype="object" if f == "cigar" else "Int32") for f in fields})

    return run(query, reference)


def suffix_prefix_columns(a: Column, b: Column, error: float, least: int, most_mismatches: int | None = None) -> Column:
    """struct<overlap, score, mismatches>; null where there is none."""

    @F.pandas_udf("overlap int, score int, mismatches int")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for left, right in batches:
            found = [suffix_prefix(x, y, 1, -4, error, least, most_mismatches) if isinstance(x, str) and isinstance(y, str) else None for x, y in zip(left, right, strict=True)]
            yield pd.DataFrame({f: pd.array([None if o is None else o[i] for o in found], dtype="Int32") for i, f in enumerate(("overlap", "score", "mismatches"))})

    return run(a, b)
