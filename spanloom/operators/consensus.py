"""Consensus sequences of clusters of reads by voting per column."""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BASES = "ACGT"

#: Columns of a cluster whose consensus is one row.
_COLUMNS = 512

_CIGAR_OP = re.compile(r"(\d+)([MIDNSHP=X])")


def column_votes(reads: DataFrame, keys: list[str], seq: str, offset: str, qual: str | None = None) -> DataFrame:
    """For each cluster and column the base with most votes: keys, col, base, votes.

    Ties go to the larger sum of qualities (Phred+33), then to the first of A, C, G, T. Other letters do not vote."""
    letters = F.split(F.upper(seq), "")
    if qual:
        chars = reads.select(*keys, F.col(offset).alias("__o"), F.posexplode(F.arrays_zip(letters.alias("b"), F.split(F.col(qual), "").alias("q"))).alias("__i", "__z")).select(*keys, "__o", "__i", "__z.*")
    else:
        chars = reads.select(*keys, F.col(offset).alias("__o"), F.posexplode(letters).alias("__i", "b"))
    of = lambda value: [F.when(F.col("b") == base, value) for base in BASES]
    votes = [F.count(x).alias(f"__n{i}") for i, x in enumerate(of(F.lit(1)))]
    sums = [F.coalesce(F.sum(x), F.lit(-1)).alias(f"__q{i}") for i, x in enumerate(of(F.ascii("q") - 33))] if qual else []
    counted = chars.where(F.col("b").isin(*BASES)).groupBy(*keys, (F.col("__o") + F.col("__i")).cast("long").alias("col")).agg(*votes, *sums)
    ranked = [F.struct(F.col(f"__n{i}").alias("votes"), (F.col(f"__q{i}") if qual else F.lit(0)).alias("q"), F.lit(-i).alias("order"), F.lit(base).alias("base")) for i, base in enumerate(BASES)]
    return counted.select(*keys, "col", F.greatest(*ranked).alias("__best")).select(*keys, "col", "__best.base", "__best.votes")


def vote(seqs: list[str], quals: list[str | None], offsets: list[int]) -> str:
    """The consensus of reads laid at offsets >= 0; a column that no base covers gives A."""
    length = max((o + len(s) for s, o in zip(seqs, offsets, strict=True)), default=0)
    counts, scores = np.zeros((4, length), dtype=np.int64), np.zeros((4, length), dtype=np.int64)
    for s, q, o in zip(seqs, quals, offsets, strict=True):
        letters = np.frombuffer(s.upper().encode(), dtype=np.uint8)
        values = np.frombuffer(q.encode(), dtype=np.uint8).astype(np.int64) - 33 if q else np.zeros(len(letters), dtype=np.int64)
        for b, base in enumerate(BASES):
            at = np.flatnonzero(letters == ord(base)) + o
            counts[b, at] += 1
            scores[b, at] += values[at - o]
    best = np.zeros(length, dtype=np.int64)
    for b in range(1, 4):
        i = np.arange(length)
        better = (counts[b] > counts[best, i]) | ((counts[b] == counts[best, i]) & (scores[b] > scores[best, i]))
        best[better] = b
    return "".join(BASES[b] for b in best)


def mismatches(seq: str, consensus: str, offset: int, low: int = 0, high: int | None = None) -> int:
    """Places low <= i < high of the read that differ from the consensus."""
    high = len(seq) if high is None else high
    return sum(seq[i].upper() != consensus[offset + i] for i in range(low, high))


def indel_shift(cigar: str, n: int) -> int:
    """Inserted less deleted bases within the first n bases along the reference (as functions.cigar.indels_in_first has them)."""
    at = shift = 0
    for size, op in ((int(a), b) for a, b in _CIGAR_OP.findall(cigar)):
        if at >= n:
            break
        if op == "I":
            shift += size
        elif op == "D":
            shift -= min(size, n - at)
        if op in "MDN=XS":
            at += size
    return shift


def clip_consensus(reads: pd.DataFrame, side: str, error: float) -> dict | None:
    """The consensus of one cluster of clipped reads; None if fewer than three agree.

    reads: qname, start, end, ustart, uend (unclipped), lclip, rclip, reverse, seq, qual and, for laying reads out behind the
    insertions and deletions of the first one, cigar, all with Python values."""

    def laid_out(rows: list[dict]) -> list[int]:
        steps = [r["ustart"] - rows[0]["ustart"] for r in rows]
        return [max(0, n + indel_shift(rows[0].get("cigar") or "", n)) for n in steps]

    rows = sorted(reads.to_dict("records"), key=lambda r: (r["ustart"], r["qname"]))
    if len(rows) < 3:
        return None
    offsets = laid_out(rows)
    consensus = vote([r["seq"] for r in rows], [r["qual"] for r in rows], offsets)
    most = math.ceil(error * len(consensus))
    kept = []
    for r, o in zip(rows, offsets, strict=True):
        n = len(r["seq"])
        clip = r["lclip"] if side == "L" else r["rclip"]
        in_clip = mismatches(r["seq"], consensus, o, 0, clip) if side == "L" else mismatches(r["seq"], consensus, o, n - clip, n)
        if mismatches(r["seq"], consensus, o) <= most and in_clip <= clip // 2:
            kept.append(r)
    if len(kept) < 3:
        return None
    offsets = laid_out(kept)
    consensus = vote([r["seq"] for r in kept], [r["qual"] for r in kept], offsets)
    third_start = sorted(range(len(kept)), key=lambda i: kept[i]["ustart"])[2]
    ends = sorted((r["uend"] for r in kept), reverse=True)
    head, tail = offsets[third_start], ends[0] - ends[2]
    seq = consensus[head : len(consensus) - tail]
    return {
        "start": kept[0]["ustart"] + head, "end": ends[0] - tail,
        "breakpoint": min(r["start"] for r in kept) if side == "L" else max(r["end"] for r in kept),
        "seq": seq, "fwd_clipped": sum(not r["reverse"] for r in kept), "rev_clipped": sum(bool(r["reverse"]) for r in kept),
    }


def trim_to_third(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """For clusters of three or more rows the third smallest start and the third largest end: what three rows cover from and to."""
    lo, hi = Window.partitionBy(*keys).orderBy(start), Window.partitionBy(*keys).orderBy(F.desc(end))
    ranked = df.select(*keys, start, end).withColumns({"__lo": F.row_number().over(lo), "__hi": F.row_number().over(hi)})
    picked = ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.max(F.when(F.col("__lo") == 3, F.col(start))).alias("third_start"), F.max(F.when(F.col("__hi") == 3, F.col(end))).alias("third_end"))
    return picked.where("n >= 3")


def reject_outliers(reads: DataFrame, keys: list[str], read_id: list[str], seq: str, offset: str, error: float, qual: str | None = None) -> DataFrame:
    """Reads with their mismatches against their cluster's votes and whether they stay: mismatches <= ceil(error * length).

    Only votes are counted letter by letter. The consensus is then an array for each stretch of columns, which a read meets whole."""
    reads = reads.where(F.length(seq) > 0)
    first, last = F.floor(F.col(offset) / _COLUMNS), F.floor((F.col(offset) + F.length(seq) - 1) / _COLUMNS)
    pieces = reads.select(*keys, *read_id, F.col(seq), *([qual] if qual else []), F.col(offset), F.explode_outer(F.sequence(first, last)).alias("__bin"))
    start = F.greatest(F.col("__bin") * _COLUMNS - F.col(offset), F.lit(0))  # letters before the piece
    size = F.least((F.col("__bin") + 1) * _COLUMNS - F.col(offset), F.length(seq)) - start
    cut = lambda c: F.substring(F.col(c), (start + 1).cast("int"), size.cast("int")).alias(c)
    pieces = pieces.select(*keys, *read_id, "__bin", cut(seq), *([cut(qual)] if qual else []), (F.col(offset) + start - F.col("__bin") * _COLUMNS).cast("int").alias("__at"))
    votes = column_votes(pieces, [*keys, "__bin"], seq, "__at", qual)
    filled = lambda x: F.flatten(F.transform(x, lambda v, i: F.concat(F.array_repeat(F.lit("A"), (v["col"] - F.when(i > 0, F.get(x, i - 1)["col"]).otherwise(-1) - 1).cast("int")), F.array(v["base"]))))
    texts = votes.groupBy(*keys, "__bin").agg(filled(F.array_sort(F.collect_list(F.struct("col", "base")))).alias("__text"))
    sizes = texts.groupBy(*keys).agg(F.max(F.col("__bin") * _COLUMNS + F.size("__text")).alias("__size"))
    letters = F.split(F.upper(seq), "")
    against = F.slice(F.coalesce("__text", F.array().cast("array<string>")), F.coalesce("__at", F.lit(0)) + 1, F.size(letters))
    differ = F.size(F.filter(F.zip_with(letters, against, lambda b, v: b != F.coalesce(v, F.lit("A"))), lambda x: x))
    counted = pieces.join(texts, [*keys, "__bin"], "left").select(*keys, *read_id, differ.cast("long").alias("__m"))
    counted = counted.groupBy(*keys, *read_id).agg(F.sum("__m").alias("mismatches")).join(sizes, keys)
    return counted.withColumn("kept", F.col("mismatches") <= F.ceil(F.lit(error) * F.col("__size"))).drop("__size")
