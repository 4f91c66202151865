"""Assembly of the reads of one group over their overlap graph.

Groups are cut at a number of distinct reads, so everything here is local to a group; groups are spread over tasks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators.grouped import fold_groups

#: From so many distinct reads on a group is given up.
MOST_READS = 1000
STATUSES = ("OK", "NO_SEQUENCE", "TOO_MANY_READS", "HAS_CYCLE")

Edges = list[dict[int, tuple[int, int]]]


def _homopolymer(seq: str) -> bool:
    counts = [seq.count(b) for b in "ACGT"]
    return sum(counts) > 0 and max(counts) * 10 >= sum(counts) * 8


def seeded_overlaps(seqs: list[str], least: int, mismatches: int, match: int = 1, mismatch: int = -4) -> dict[tuple[int, int], tuple[int, int]]:
    """(overlap, score) of the best ungapped overlap of a suffix of i with a prefix of j, for all pairs that have one of `least`
    letters with at most so many mismatches; of equal scores the longer one.

    Of mismatches + 1 pieces of a sequence's first `least` letters one is whole in each such overlap. So an index of all words of
    that length says which overlaps there may be, and only these are compared."""
    size = least // (mismatches + 1)
    letters = [np.frombuffer(s.encode(), dtype=np.uint8) for s in seqs]
    index: dict[str, list[tuple[int, int]]] = {}
    for i, s in enumerate(seqs):
        for at in range(len(s) - size + 1):
            index.setdefault(s[at : at + size], []).append((i, at))
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for j, s in enumerate(seqs):
        for off in range(0, (mismatches + 1) * size, size) if len(s) >= least else ():
            for i, at in index.get(s[off : off + size], ()):
                n = len(seqs[i]) - at + off
                if i == j or at < off or not least <= n <= len(s):
                    continue
                held = best.get((i, j))
                if held is not None and (match * n, n) <= held[::-1]:
                    continue
                m = int(np.count_nonzero(letters[i][at - off :] != letters[j][:n]))
                if m <= mismatches and (held is None or (match * (n - m) + mismatch * m, n) > held[::-1]):
                    best[i, j] = (n, match * (n - m) + mismatch * m)
    return best


def overlap_graph(seqs: list[str], layers: list[int], least: int, mismatches: int) -> Edges:
    """For each sequence its successors with (score, overlap). A sequence is followed by one of its own or a later layer; of
    two sequences that could follow each other the better direction counts, the first of equals."""
    found = seeded_overlaps(seqs, least, mismatches)
    proper = {(i, j): (score, n) for (i, j), (n, score) in found.items() if layers[i] <= layers[j] and n < min(len(seqs[i]), len(seqs[j])) and not _homopolymer(seqs[j][:n])}
    edges: Edges = [{} for _ in seqs]
    for i, j in sorted({(min(p), max(p)) for p in proper}):
        there, back = proper.get((i, j)), proper.get((j, i))
        if there and (not back or there[0] >= back[0]):
            edges[i][j] = there
        elif back:
            edges[j][i] = back
    return edges


def reverse_order(edges: Edges) -> list[int]:
    """Vertices with every one after all that follow it; shorter than the graph if there is a cycle."""
    left = [len(e) for e in edges]
    before: list[list[int]] = [[] for _ in edges]
    for i, e in enumerate(edges):
        for j in e:
            before[j].append(i)
    out = [i for i, n in enumerate(left) if n == 0]
    for i in out:
        for j in before[i]:
            left[j] -= 1
            if left[j] == 0:
                out.append(j)
    return out


def break_cycles(seqs: list[str], layers: list[int], least: int, longest: int) -> tuple[Edges, bool]:
    """The overlap graph without cycles: exact overlaps only, then longer and longer ones, if it has some. False if none helps."""
    edges = overlap_graph(seqs, layers, least, 1)
    if len(reverse_order(edges)) == len(seqs):
        return edges, True
    edges = overlap_graph(seqs, layers, least, 0)
    while len(reverse_order(edges)) < len(seqs):
        least += 10
        if least > longest // 2:
            return edges, False
        edges = [{j: e for j, e in row.items() if e[1] >= least} for row in edges]
    return edges, True


def heaviest_paths(edges: Edges, may_start: list[bool], may_end: list[bool]) -> list[list[int]]:
    """Paths of the largest sum of scores, each over vertices that no earlier one has, until none with an edge is left."""
    used = [False] * len(edges)
    order = reverse_order(edges)
    out: list[list[int]] = []
    while True:
        best: list[tuple[int, int]] = [(0, -1)] * len(edges)  # score from here on, successor
        ends = [may_end[i] for i in range(len(edges))]
        for i in order:
            if used[i]:
                continue
            found = (0, -1) if may_end[i] else (-1, -1)
            for j, (score, _) in edges[i].items():
                if not used[j] and ends[j] and score + best[j][0] > found[0]:
                    found = (score + best[j][0], j)
            best[i], ends[i] = found, found[0] >= 0
        starts = [i for i in range(len(edges)) if not used[i] and may_start[i] and ends[i] and best[i][1] >= 0]
        if not starts:
            return out
        at = max(starts, key=lambda i: (best[i][0], -i))
        path = []
        while at >= 0:
            path.append(at)
            used[at] = True
            at = best[at][1]
        out.append(path)


def spell(path: list[int], seqs: list[str], edges: Edges) -> str:
    """The path's sequence, each column by majority of the reads on it (the first of A, C, G, T of equals)."""
    starts, at = [0], 0
    for a, b in zip(path, path[1:], strict=False):
        at += len(seqs[a]) - edges[a][b][1]
        starts.append(at)
    length = max(s + len(seqs[i]) for s, i in zip(starts, path, strict=True))
    columns: list[dict[str, int]] = [{} for _ in range(length)]
    for s, i in zip(starts, path, strict=True):
        for k, base in enumerate(seqs[i]):
            columns[s + k][base] = columns[s + k].get(base, 0) + 1
    return "".join(max(sorted(c), key=c.__getitem__) for c in columns)


def assemble(reads: list[tuple[str, int, bool, bool]], least: int, read_len: int) -> tuple[str, list[str]]:
    """(status, contigs in order of their paths' scores). reads: sequence, layer (1 to 3), may start and may end a path."""
    distinct = list({(s, layer): (s, layer, a, b) for s, layer, a, b in reversed(reads) if s and "N" not in s}.values())[::-1]
    if not distinct:
        return "NO_SEQUENCE", []
    if len(distinct) >= MOST_READS:
        return "TOO_MANY_READS", []
    seqs, layers = [d[0] for d in distinct], [d[1] for d in distinct]
    edges, acyclic = break_cycles(seqs, layers, least, read_len)
    if not acyclic:
        return "HAS_CYCLE", []
    return "OK", [spell(p, seqs, edges) for p in heaviest_paths(edges, [d[2] for d in distinct], [d[3] for d in distinct])]


def assemble_groups(reads: DataFrame, group: str, seq: str, layer: str, order: list[str], least: int, read_len: int) -> DataFrame:
    """For each group status, contig (0 for the heaviest path; -1 without any) and seq.

    Equal reads of a layer are one, at the last one's place, and groups are counted before any is gathered: only those with fewer than
    MOST_READS distinct reads are. Reads that are null, empty or hold an N count as none; rows without a group are left out."""
    kind = reads.schema[group].dataType.simpleString()
    usable = F.when((F.length(seq) > 0) & ~F.contains(F.col(seq), F.lit("N")), F.col(seq))
    distinct = reads.where(F.col(group).isNotNull()).groupBy(group, usable.alias("__seq"), F.col(layer).alias("__layer")).agg(F.max(F.struct(*order)).alias("__at"))
    counts = distinct.groupBy(group).agg(F.count("__seq").alias("__n"))
    none = (F.col("__n") == 0) | (F.col("__n") >= MOST_READS)
    given_up = counts.where(none).select(group, F.when(F.col("__n") == 0, "NO_SEQUENCE").otherwise("TOO_MANY_READS").alias("status"), F.lit(-1).alias("contig"), F.lit(None).cast("string").alias("seq"))

    def fold(rows: list[dict]) -> list[tuple]:
        status, contigs = assemble([(r["__seq"], r["__layer"], True, True) for r in rows], least, read_len)
        return [(rows[0][group], status, n, c) for n, c in enumerate(contigs)] or [(rows[0][group], status, -1, None)]

    small = distinct.where("__seq is not null").join(counts.where(~none).select(group), group)
    return given_up.unionByName(fold_groups(small, [group], ["__at"], fold, f"`{group}` {kind}, status string, contig int, seq string"))
