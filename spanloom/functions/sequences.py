"""Sequences, base qualities and small interval arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A sequence of which one base makes up this share is a homopolymer.
HOMOPOLYMER = 0.8


def reverse_complement(seq: Column) -> Column:
    """Bases come out in upper case; other letters stay as they are."""
    return F.translate(F.reverse(seq), "ACGTacgt", "TGCATGCA")


def fastq_sequence(seq: Column, reverse: Column) -> Column:
    """The sequence as it was read."""
    return F.when(reverse, reverse_complement(seq)).otherwise(seq)


def fastq_quality(qual: Column, reverse: Column) -> Column:
    return F.when(reverse, F.reverse(qual)).otherwise(qual)


def mean_quality(qual: Column) -> Column:
    """Mean of the Phred scores of a Phred+33 string; null if it is empty."""
    total = F.aggregate(F.filter(F.split(qual, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda n, c: n + F.ascii(c) - 33)
    return F.try_divide(total.cast("double"), F.length(qual))


def base_count(seq: Column, base: str) -> Column:
    return F.length(seq) - F.length(F.replace(F.upper(seq), F.lit(base), F.lit("")))


def is_homopolymer(seq: Column, share: float = HOMOPOLYMER) -> Column:
    """False for a sequence without bases. Counts are compared in tenths, so that no rounding decides."""
    counts = [base_count(seq, b) for b in "ACGT"]
    total = counts[0] + counts[1] + counts[2] + counts[3]
    return (total > 0) & (F.greatest(*counts) * 10 >= total * int(round(share * 10)))


def hamming(a: Column, b: Column) -> Column:
    """Differing places of two strings of equal length."""
    return F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), lambda d: d))


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Length of the common part of two half-open intervals."""
    zero = F.lit(0).cast("long")
    return F.greatest(zero, F.least(e1, e2) - F.greatest(s1, s2))


def exact_suffix_prefix(a: Column, b: Column, least: int, most: int | None = None) -> Column:
    """Length of the longest suffix of `a`, from `least` on, that is a prefix of `b`; null if there is none."""
    top = F.least(F.length(a), F.length(b))
    if most is not None:
        top = F.least(top, F.lit(most))
    lengths = F.when(top >= least, F.sequence(F.lit(least), top)).otherwise(F.array().cast("array<int>"))
    return F.array_max(F.filter(lengths, lambda k: F.right(a, k) == F.left(b, k)))


def fold_microhomology(start: Column, end: Column, prefix: Column, seq: Column) -> Column:
    """struct<start, seq, mh_len>: where start lies beyond end, the reference between them (prefix, upper-cased) becomes the
    beginning of the inserted sequence and the insertion starts at end."""
    crossed = start > end
    return F.struct(
        F.when(crossed, end).otherwise(start).alias("start"),
        F.when(crossed, F.concat(F.upper(prefix), seq)).otherwise(seq).alias("seq"),
        F.when(crossed, start - end).otherwise(F.lit(0).cast("long")).alias("mh_len"),
    )


def shared_prefix_length(a: Column, b: Column) -> Column:
    """How many leading characters two strings have in common."""
    n = F.least(F.length(a), F.length(b))
    lengths = F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.coalesce(F.array_max(F.filter(lengths, lambda k: F.left(a, k) == F.left(b, k))), F.lit(0))
