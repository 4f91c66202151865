"""Expressions on alignments of sequences to a region: clips, scores along the reference, and what makes an alignment count."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.functions import cigar as C
from spanloom.functions import flags as P

#: Bases of padding at an end whose alignment is forced, the least clip that counts, the least insertion, and how far
#: a remapped read may end from a strict limit.
PADDING, LEAST_CLIP, LEAST_INSERTION, SLACK = 7, 15, 50, 5
#: Operations as numbers in packed CIGARs, in this order.
_CODES = "MIDNSHP=X"


def endpoint(flag: Column, pos: Column, cigar: Column) -> Column:
    """The end that points at the mate's side: the start of a reverse read, the end of a forward one."""
    return F.when(P.is_reverse(flag), pos).otherwise(C.end_position(pos, cigar))


def start_offset(first_start: Column, first_cigar: Column, start: Column) -> Column:
    """Where a read begins on the first read of its cluster: the distance of their unclipped starts, with what is inserted in that
    stretch of the first read, without what is deleted."""
    distance = (start - first_start).cast("int")
    indels = C.indels_in_first(first_cigar, distance)
    return distance + indels["ins"] - indels["dels"]


def base_score(a: Column, b: Column, match: int, mismatch: int) -> Column:
    """Case aside; N matches everything."""
    same = (F.upper(a) == F.upper(b)) | (a == "N") | (b == "N")
    return F.when(same, match).otherwise(mismatch)


def pack_cigar(cigar: Column) -> Column:
    """array<long>: each operation's length times 16 plus its number."""
    return F.transform(C.ops(cigar), lambda o: o["len"].cast("long") * 16 + F.instr(F.lit(_CODES), o["op"]) - 1)


def unpack_cigar(packed: Column) -> Column:
    return F.array_join(F.transform(packed, lambda n: F.concat(F.shiftright(n, 4).cast("string"), F.substring(F.lit(_CODES), (n.bitwiseAND(F.lit(15)) + 1).cast("int"), F.lit(1)))), "")


def inserted_bases(cigar: Column) -> Column:
    return C.total(cigar, "I")


def fully_aligned(cigar: Column, query_begin: Column, query_end: Column, size: Column, least_clip: int = LEAST_CLIP, least_insertion: int = LEAST_INSERTION) -> Column:
    """The query is covered up to less than a clip at each end (query_end: its last base), and no insertion, nor all together,
    is an event of its own."""
    return (query_begin < least_clip) & (query_end > size - 1 - least_clip) & (inserted_bases(cigar) < least_insertion)


def good_anchor(query_begin: Column, query_end: Column, size: Column, left: bool, least_clip: int = LEAST_CLIP, padding: int = PADDING) -> Column:
    """An anchor reaches its padded end and is long enough."""
    reaches = query_begin == 0 if left else query_end == size - 1
    return reaches & (query_end - query_begin >= least_clip + padding)


def _noise(clip: Column, quality: Column | None, left: bool, least_quality: int, padding: int) -> Column:
    """A clip of less than half of the read that is low in quality, where the rest is not."""
    if quality is None:
        return F.lit(False)
    from spanloom.functions.sequences import mean_quality

    n, size = (clip - padding).cast("int"), F.length(quality)
    own = F.when(n > 0, F.substring(quality, F.lit(1), n) if left else F.substring(quality, size - n + 1, n))
    rest = F.when(n > 0, F.substring(quality, n + 1, size) if left else F.substring(quality, F.lit(1), size - n))
    return F.coalesce((n > 0) & (n < F.floor(size / 2)) & (mean_quality(own) < least_quality) & (mean_quality(rest) >= least_quality), F.lit(False))


def accepts(cigar: Column, query_begin: Column, query_end: Column, mismatches: Column, most_error: float = 1.0, quality: Column | None = None, least_quality: int = 0, padding: int = PADDING) -> Column:
    """Whether an alignment of a query with `padding` Ns at both ends counts: it is clipped beyond the padding at neither end, or
    at one of them by noise, and its rate of mismatches, without those of aligned padding, is low enough."""
    left, right = C.left_clip(cigar), C.right_clip(cigar)
    aligned = F.greatest(padding - left, F.lit(0)) + F.greatest(padding - right, F.lit(0))
    rate = F.try_divide((mismatches - aligned).cast("double"), query_end - query_begin - aligned)
    whole = lambda clip, is_left: (clip <= padding) | _noise(clip, quality, is_left, least_quality, padding)
    return ~((left > padding) & (right > padding)) & whole(left, True) & whole(right, False) & F.coalesce(rate <= most_error, F.lit(False))


def prefix_scores(cigar: Column, match: int = 1, mismatch: int = -4, gap_open: int = -6, gap_extend: int = -1) -> Column:
    """array<int>: the alignment's score up to each base of the reference that it covers, from none on. A deletion's bases carry
    the score before it."""

    def step(s: Column, o: Column) -> Column:
        gap = gap_open + o["len"] * gap_extend
        each = F.when(o["op"] == "=", match).when(o["op"] == "X", mismatch).otherwise(0)
        on_reference = o["op"].isin("=", "X", "D")
        more = F.when(on_reference, F.transform(F.sequence(F.lit(1), o["len"]), lambda k: s["score"] + k * each)).otherwise(F.array().cast("array<int>"))
        total = s["score"] + F.when(o["op"].isin("=", "X"), o["len"] * each).when(o["op"].isin("D", "I"), gap).otherwise(0)
        return F.struct(total.alias("score"), F.concat(s["out"], more).alias("out"))

    zero = F.struct(F.lit(0).alias("score"), F.array(F.lit(0)).alias("out"))
    return F.aggregate(F.filter(C.ops(cigar), lambda o: o["len"] > 0), zero, step, lambda s: s["out"])


def anchor_distance(start: Column, end: Column, start2: Column, end2: Column) -> Column:
    """What the union of two anchors spans."""
    return F.greatest(end, end2) - F.least(start, start2)


def may_merge(direction: Column, start: Column, end: Column, clips: Column, start2: Column, end2: Column, clips2: Column, most: int, slack: int = SLACK) -> Column:
    """Anchors of one direction may merge if their union spans at most `most` and neither goes more than `slack` beyond the
    other's end on the side where that is held by clipped reads."""
    left = direction == "L"
    held = lambda s, e, s2, e2: F.when(left, s <= s2 + slack).otherwise(e >= e2 - slack)
    return ((clips == 0) | held(start, end, start2, end2)) & ((clips2 == 0) | held(start2, end2, start, end)) & (anchor_distance(start, end, start2, end2) <= most)


def region_text(contig: Column, pos: Column, reach: int) -> Column:
    """`contig:from-to` around a position, from 1 on."""
    return F.concat(contig, F.lit(":"), F.greatest(F.lit(1), pos - reach).cast("string"), F.lit("-"), (pos + reach).cast("string"))


def remap_accepted(score: Column, start: Column, end: Column, cigar: Column, low: Column, high: Column, least: int = 30, slack: int = SLACK) -> Column:
    """A mate's place in a region counts from a score on, inside the region's strict limits, and where it is clipped at a limit."""
    outside = (end < low) | (start > high)
    wrong = ((C.left_clip(cigar) > 0) & (low < start - slack)) | ((C.right_clip(cigar) > 0) & (end + slack < high))
    return (score >= least) & ~outside & ~wrong
