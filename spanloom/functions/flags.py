"""Predicates over alignment flags. Every function takes and returns columns, so the optimiser sees plain expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.functions.cigar import left_clip, right_clip, unclipped_end, unclipped_start

#: Bits of the alignment flag.
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE, READ1, READ2, SECONDARY, SUPPLEMENTARY = 0x1, 0x2, 0x4, 0x8, 0x10, 0x20, 0x40, 0x80, 0x100, 0x800
#: A pair whose template is longer than this is discordant.
FAR = 100_000


def has(flag: Column, bits: int) -> Column:
    return flag.bitwiseAND(F.lit(bits)) != 0


def is_unmapped(flag: Column) -> Column:
    return has(flag, UNMAPPED)


def is_mate_unmapped(flag: Column) -> Column:
    return has(flag, MATE_UNMAPPED)


def is_primary(flag: Column) -> Column:
    return ~has(flag, SECONDARY | SUPPLEMENTARY)


def is_proper_pair(flag: Column) -> Column:
    return is_primary(flag) & has(flag, PROPER)


def is_reverse(flag: Column) -> Column:
    return has(flag, REVERSE)


def is_same_contig(contig: Column, mate_contig: Column) -> Column:
    return F.coalesce(contig == mate_contig, F.lit(False))


def is_same_strand(flag: Column) -> Column:
    """Both mates forward. Two reverse mates do not count: the two strand bits are compared as masks of different value."""
    return flag.bitwiseAND(F.lit(REVERSE)) == flag.bitwiseAND(F.lit(MATE_REVERSE))


def is_discordant(flag: Column, contig: Column, mate_contig: Column, isize: Column) -> Column:
    """On different contigs, too far apart, or with just one mate mapped."""
    return ~is_same_contig(contig, mate_contig) | (F.abs(isize) > FAR) | (is_unmapped(flag) != is_mate_unmapped(flag))


def is_left_clipped(flag: Column, cigar: Column, least: int | Column = 1) -> Column:
    return ~is_unmapped(flag) & (left_clip(cigar) >= least)


def is_right_clipped(flag: Column, cigar: Column, least: int | Column = 1) -> Column:
    return ~is_unmapped(flag) & (right_clip(cigar) >= least)


def is_mate_clipped(mate_cigar: Column) -> Column:
    """Clipped at both ends: a mate that is clipped at one end counts as unclipped."""
    return F.coalesce(mate_cigar.rlike(r"^\d+S") & mate_cigar.rlike("S$"), F.lit(False))


def stable_end(flag: Column, cigar: Column, mapq: Column, mate_mapq: Column, least_clip: int) -> Column:
    """`R` for a forward read not clipped on its left, `L` for a reverse read not clipped on its right, if it is mapped at
    least as well as its mate; null otherwise."""
    stable = ~is_unmapped(flag) & (mapq >= mate_mapq)
    return F.when(stable & is_reverse(flag) & ~is_right_clipped(flag, cigar, least_clip), "L").when(stable & ~is_reverse(flag) & ~is_left_clipped(flag, cigar, least_clip), "R")


def mate_key(qname: Column, flag: Column, same_contig: Column, own: bool = True) -> Column:
    """Key of a read's sequence among those of its mate's contig; own=False gives the key under which the mate looks for it."""
    number = F.when(has(flag, READ1), 1).otherwise(2)
    return F.when(same_contig, F.concat(qname, F.lit("_"), (number if own else 3 - number).cast("string"))).otherwise(qname)


def clip_side(pos: Column, cigar: Column, length: Column, least: int) -> Column:
    """`L` or `R` for a read with a clip of `least` bases or more on that side and a shorter one, or none, on the other, whose
    clipped side, laid out, stays on the contig (of `length`); null otherwise."""
    left, right = left_clip(cigar), right_clip(cigar)
    is_left = (left >= least) & (right < least) & (unclipped_end(pos, cigar) < length)
    is_right = (right >= least) & (left < least) & (unclipped_start(pos, cigar) >= 0)
    return F.when(is_left, "L").when(is_right, "R")


def is_sampled_pair(flag: Column, isize: Column, cigar: Column, mate_cigar: Column, most: int = 20_000, clipped_too: bool = False) -> Column:
    """A pair that insert sizes are sampled from: proper, its left mate, shorter than `most`, and with no clip at either mate."""
    whole = F.lit(True) if clipped_too else F.coalesce(~cigar.contains("S") & ~mate_cigar.contains("S"), F.lit(False))
    return is_proper_pair(flag) & (isize > 0) & (isize < most) & whole


def is_spanning_pair(flag: Column, contig: Column, mate_contig: Column, isize: Column, cigar: Column, mate_cigar: Column, most: int) -> Column:
    """The left mate of a pair on one contig, with opposite strands, of `most` bases at most, unclipped."""
    unclipped = (left_clip(cigar) == 0) & (right_clip(cigar) == 0) & ~is_mate_clipped(mate_cigar)
    return (isize > 0) & (isize <= most) & is_same_contig(contig, mate_contig) & ~is_same_strand(flag) & unclipped
