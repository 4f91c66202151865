"""Order-dependent clustering. What is sequential happens inside bins of places, which hand on what other bins may change."""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.alignments import SLACK
from spanloom.operators.grouped import fold_columns
from spanloom.operators.rounds import in_rounds
from spanloom.operators.running import next_place, running_total


def islands(df: DataFrame, keys: list[str], at: str, gap: int, name: str = "island") -> DataFrame:
    """Numbers the runs of rows of a key in which neighbours in order of `at` (longs) are at most `gap` apart.

    Distinct places are looked at, in two levels: a place's neighbour within its bin or the bins' bounds, and a running count
    of gaps; so a key with very many rows is spread over tasks."""
    places = next_place(df.select(*keys, at).distinct(), keys, at, "__next")
    after = places.where(F.col("__next") - F.col(at) > gap).select(*keys, F.col("__next").alias("__after"), F.lit(1).cast("long").alias("__gap"))
    joined = places.select(*keys, at).join(after.withColumnsRenamed({k: f"__{k}" for k in keys}), _same(keys) & (F.col(at) == F.col("__after")), "left")
    marked = joined.select(*keys, at, F.coalesce("__gap", F.lit(0).cast("long")).alias("__gap"))
    numbers = running_total(marked, keys, at, "__gap", "__n").select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(at).alias("__at"), (F.col("__n") + 1).alias(name))
    return df.join(numbers, _same(keys) & (F.col(at) == F.col("__at"))).drop("__at", *[f"__{k}" for k in keys])


def _same(keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return out


#: Places for each bin of anchored clustering; a larger distance takes larger bins.
_ANCHOR_BIN = 1 << 16


def anchored_clusters(df: DataFrame, keys: list[str], at: str, tie: str, distance: int, name: str = "anchor") -> DataFrame:
    """Adds each row's anchor: the position of its cluster's first member. In order of (at, tie) a row further than
    `distance` from the anchor begins a new cluster, so unlike a session window a chain of near rows does not go on for ever.

    What a bin of positions does to the anchor that reaches it from the left is a small table: for each place that may be its
    first anchor (those within `distance` of the bin's start and the next one) the last anchor that follows from it. Bins make
    their tables on their own, one pass along the key's tables, a fraction of the data, hands the anchor from bin to bin, and
    then bins place their rows on their own. So no task holds a key, however dense it is."""
    width = max(_ANCHOR_BIN, 16 * distance)
    place = F.col(at).cast("long")
    places = df.select(*keys, place.alias("at"), F.floor((place - F.pmod(place, F.lit(width))) / width).cast("long").alias("bin")).where("at is not null").distinct()
    schema = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)

    def table(part: pa.Table) -> dict:
        p, edge = part.column("at").to_numpy(), part.column("bin")[0].as_py() * width + distance
        follow = np.searchsorted(p, p + distance, "right")
        last = np.arange(len(p))
        for i in np.flatnonzero(follow < len(p))[::-1].tolist():
            last[i] = last[follow[i]]
        n = min(len(p), int(np.searchsorted(p, edge, "left")) + 1)
        return {"first": p[:n], "last": p[last[:n]]}

    def enter(part: pa.Table) -> dict:
        """The anchor that reaches each bin, in order; a bin's table is passed over up to its first fitting row."""
        bins, first, last = (part.column(c).to_numpy() for c in ("bin", "first", "last"))
        starts = np.flatnonzero(np.append(True, bins[1:] != bins[:-1]))
        out, anchor = [], None
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(bins)], strict=True):
            out.append(anchor)
            i = a if anchor is None else a + int(np.searchsorted(first[a:b], anchor + distance, "right"))
            anchor = int(last[i]) if i < b else anchor
        return {"bin": bins[starts], "entry": out}

    def settle(part: pa.Table) -> dict:
        p, anchor = part.column("at").to_numpy(), part.column("entry")[0].as_py()
        out, i = np.empty(len(p), dtype=np.int64), 0
        while i < len(p):
            j = 0 if anchor is None else int(np.searchsorted(p, anchor + distance, "right"))
            out[i:j] = anchor or 0
            if (i := max(i, j)) < len(p):
                anchor = int(p[i])
                out[i] = anchor
                i += 1
        return {"at": p, "anchor": out}

    tables = fold_columns(places, [*keys, "bin"], ["at"], table, f"{schema}bin long, first long, last long")
    entries = fold_columns(tables, keys, ["bin", "first"], enter, f"{schema}bin long, entry long").withColumnsRenamed({k: f"__{k}" for k in keys} | {"bin": "__bin"})
    known = places.join(entries, _same(keys) & (F.col("bin") == F.col("__bin"))).select(*keys, "bin", "at", "entry")
    found = fold_columns(known, [*keys, "bin"], ["at"], settle, f"{schema}at long, anchor long").select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("at").alias("__at"), F.col("anchor").alias(name))
    return df.join(found, _same(keys) & (place == F.col("__at"))).drop("__at", *[f"__{k}" for k in keys])


def merge_equal_intervals(df: DataFrame, keys: list[str], start: str, end: str, sums: list[str]) -> DataFrame:
    """One row for each distinct interval with the sums of these columns and the number of rows."""
    return df.groupBy(*keys, start, end).agg(*[F.sum(c).alias(c) for c in sums], F.count("*").alias("members"))


def agglomerate_part(
    clusters: list[tuple[int, int, bool]], most: int, low: float, high: float, clipped: list[bool] | None = None, left: bool = True, slack: int = SLACK
) -> tuple[list[int], list[list[int]], list[bool]]:
    """One bin's part of agglomerate(): for each cluster (start, end, made by a merge), in order, the one that it went into, the bounds
    of each by then, and whether it is settled, so that nothing outside can change it.

    Clusters that start within `most` of the bin's ends may have partners outside. They are held, and so is a cluster once its
    next merge would be with one that is held. Merging only makes spans longer, so what a cluster did before is certain.

    clipped: which clusters' starts (left) or ends (not left) are given by clipped reads, so that no partner may lie more than `slack`
    beyond; a cluster that merges with such a one becomes one, and the list is brought up to date."""
    n, starts = len(clusters), [c[0] for c in clusters]
    box, fresh = [[a, b] for a, b, _ in clusters], [c[2] for c in clusters]
    held = [s - most < low or s + most >= high for s in starts]
    up = list(range(n))
    heap: list[tuple[int, int, int, int, int]] = []  # weighted span, two clusters, and how often each had been merged
    clipped = [False] * n if clipped is None else clipped
    side, sign = (0, 1) if left else (1, -1)
    reach = lambda a, b: max(box[a][1], box[b][1]) - min(box[a][0], box[b][0])
    kept = lambda a, b: not clipped[a] or sign * box[a][side] <= sign * box[b][side] + slack
    fits = lambda a, b: reach(a, b) <= most and kept(a, b) and kept(b, a)
    for i in range(n):
        for j in range(i + 1, n):
            if box[j][0] - box[i][0] > most:
                break
            if fits(i, j):
                heap.append(((1 + (fresh[i] or fresh[j])) * reach(i, j), i, j, 0, 0))
    heapq.heapify(heap)
    version = [0] * n
    alive = [True] * n
    while heap:
        _, i, j, *then = heapq.heappop(heap)
        if not (alive[i] and alive[j]) or then != [version[i], version[j]]:
            continue
        if held[i] or held[j]:
            held[i] = held[j] = True
            continue
        box[i] = [min(box[i][0], box[j][0]), max(box[i][1], box[j][1])]
        alive[j], up[j], fresh[i], clipped[i] = False, i, True, clipped[i] or clipped[j]
        version[i] += 1
        # a cluster begins where its first member does, so those within reach are neighbours in order
        for k in range(bisect_left(starts, starts[i] - most), bisect_right(starts, starts[i] + most)):
            if k != i and alive[k] and fits(i, k):
                a, b = min(i, k), max(i, k)
                heapq.heappush(heap, (2 * reach(i, k), a, b, version[a], version[b]))

    def root(i: int) -> int:
        while up[i] != i:
            i = up[i]
        return i

    roots = [root(i) for i in range(n)]
    return roots, box, [not held[r] for r in roots]


def agglomerate(spans: list[tuple[int, int]], most: int, clipped: list[bool] | None = None, left: bool = True, slack: int = SLACK) -> list[int]:
    """For each interval, in order of (start, end), the index of its cluster's first member.

    The two clusters whose union spans least are merged again and again, as long as it spans at most `most`; of equal spans
    the pair with the smaller indices goes first. Pairs that come up after a merge count with twice their span, so that
    initial pairs go before them. clipped, left and slack: see agglomerate_part."""
    return agglomerate_part([(a, b, False) for a, b in spans], most, float("-inf"), float("inf"), None if clipped is None else list(clipped), left, slack)[0]


def agglomerative_clusters(df: DataFrame, keys: list[str], start: str, end: str, most: int, name: str = "cluster", clips: str | None = None, side: str | None = None, slack: int = SLACK) -> DataFrame:
    """Adds the start and end of each row's cluster (see agglomerate) and its first member, which tells a key's clusters apart: that
    one's start (`island`) and end (`name`).

    clips: a count of clipped reads that hold an interval's start, or its end where `side`, one of the keys, is R; no partner of it, or of
    a cluster that it is in, lies more than `slack` beyond.

    Equal intervals are merged first. Clusters merge only with those that start within `most` of them, so bins of starts settle
    theirs in rounds, and a key without gaps is spread over tasks."""
    held = F.lit(False) if clips is None else F.coalesce(F.col(clips) > 0, F.lit(False))
    whole = df.groupBy(*keys, start, end).agg(F.max(held).alias("__clipped")).select(*keys, F.col(start).cast("long").alias(start), F.col(end).cast("long").alias(end), "__clipped")
    rows = whole.select(*keys, start, end, F.col(start).alias("cluster_start"), F.col(end).alias("__first"), F.col(end).alias("cluster_end"), F.lit(False).alias("__merged"), "__clipped")

    def fold(group: list[dict], low: int, high: int) -> list[tuple]:
        of: dict[tuple[int, int], int] = {}
        for r in group:
            of.setdefault((r["cluster_start"], r["__first"]), len(of))
        known = {of[r["cluster_start"], r["__first"]]: (r["cluster_start"], r["cluster_end"], r["__merged"]) for r in group}
        clipped = {of[r["cluster_start"], r["__first"]]: r["__clipped"] for r in group}
        clipped = [clipped[i] for i in range(len(of))]
        roots, box, settled = agglomerate_part([known[i] for i in range(len(of))], most, low, high, clipped, side is None or group[0][side] != "R", slack)
        heads, grown = list(of), {r for i, r in enumerate(roots) if r != i}
        out = []
        for r in group:
            i = of[r["cluster_start"], r["__first"]]
            to = roots[i]
            out.append((*[r[k] for k in keys], r[start], r[end], *heads[to], box[to][1], known[to][2] or to in grown, clipped[to], settled[i]))
        return out

    found = in_rounds(rows, keys, "cluster_start", most, ["cluster_start", "__first"], fold, "agglomerate")
    return df.join(found.select(*keys, start, end, F.col("cluster_start").alias("island"), F.col("__first").alias(name), "cluster_start", "cluster_end"), [*keys, start, end])


def greedy_pairs(rows: Iterator[tuple[int, object, object]]) -> list[tuple[object, object]]:
    """(weight, a, b) in order of weight, largest first, then a, then b: a pair is taken if neither side was."""
    used_a, used_b, out = set(), set(), []
    for _, a, b in sorted(rows, key=lambda r: (-r[0], r[1], r[2])):
        if a not in used_a and b not in used_b:
            used_a.add(a)
            used_b.add(b)
            out.append((a, b))
    return out


def greedy_matching(candidates: DataFrame, keys: list[str], a: str, b: str, weight: str, at: str, reach: int) -> DataFrame:
    """An exclusive matching of a and b (longs): candidates in order of weight, largest first, then a, then b.

    `at` is a place of the candidate's a such that candidates that share a side lie within `reach`. Bins of places take, in order,
    the pairs of which no side is wanted by a better one that is still open, in rounds; so a key without gaps is spread over tasks."""
    rows = candidates.select(*keys, F.col(a).cast("long").alias(a), F.col(b).cast("long").alias(b), F.col(weight), F.col(at).cast("long").alias("__at"))

    def fold(group: list[dict], low: int, high: int) -> list[tuple]:
        taken: tuple[set, set] = (set(), set())
        wanted: tuple[set, set] = (set(), set())
        out = []
        for r in sorted(group, key=lambda r: (-r[weight], r[a], r[b])):
            if r[a] in taken[0] or r[b] in taken[1]:
                continue
            sure = low <= r["__at"] - reach and r["__at"] + reach < high and r[a] not in wanted[0] and r[b] not in wanted[1]
            for side, value in zip(taken if sure else wanted, (r[a], r[b]), strict=True):
                side.add(value)
            out.append((*[r[k] for k in keys], r[a], r[b], r[weight], r["__at"], sure))
        return out

    return in_rounds(rows, keys, "__at", reach, [], fold, "matching").select(*keys, a, b)


def first_come(pairs: DataFrame, item: list[str], rank: list) -> DataFrame:
    """Each item goes to the first of its candidates in this order."""
    w = Window.partitionBy(*item).orderBy(*rank)
    return pairs.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
