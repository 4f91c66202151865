"""Evidence around calls: depth of both flanks, pairs that span breakpoints, and the discordant path's joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions import cigar as C
from spanloom.functions import flags as P
from spanloom.operators.clustering import first_come
from spanloom.operators.coverage import median_covered
from spanloom.operators.intervals import intervals_in_intervals, within_band
from spanloom.operators.running import depth_at


def flank_depths(calls: DataFrame, reads: DataFrame, width: int = 256) -> DataFrame:
    """Adds left_depth and right_depth: the median of non-zero depths over each anchor. calls: id, contig, left_anchor and
    right_anchor as `a-b`. Every record counts, secondary ones too."""
    spans = reads.select("contig", F.col("pos").alias("s"), C.end_position(F.col("pos"), F.col("cigar")).alias("e")).where("e > s")
    cut = F.split("x.anchor", "-")
    anchors = calls.select("id", "contig", F.explode(F.array(*[F.struct(F.lit(side).alias("side"), F.col(f"{side}_anchor").alias("anchor")) for side in ("left", "right")])).alias("x"))
    targets = anchors.select("id", "contig", "x.side", cut[0].cast("long").alias("lo"), cut[1].cast("long").alias("hi"))
    found = median_covered(targets, spans, ["contig"], ["id", "side"], "lo", "hi", "s", "e", width)  # depths are counted once for both
    sides = [F.max(F.when(F.col("side") == side, F.col("median"))).alias(f"{side}_depth") for side in ("left", "right")]
    return calls.join(found.groupBy("id").agg(*sides), "id", "left")


def spanning_counts(calls: DataFrame, reads: DataFrame, read_len: int, least_quality: int = 0) -> DataFrame:
    """Adds left_spanning and right_spanning: proper unclipped pairs whose inner part contains the breakpoint. The left mate
    gives the span, the right mate must be there and pass as well."""
    from spanloom.functions.sequences import mean_quality

    flag, cigar = F.col("flag"), F.col("cigar")
    good = ~P.is_unmapped(flag) & P.is_proper_pair(flag) & (C.left_clip(cigar) == 0) & (C.right_clip(cigar) == 0) & ~P.is_mate_clipped(F.col("mc")) & (F.coalesce(mean_quality(F.col("qual")), F.lit(0.0)) >= least_quality)
    rows = reads.where(good)
    left = rows.where("isize > 0").select("contig", "qname", (F.col("pos") + read_len // 2).alias("a"), (C.mate_end(F.col("mate_pos"), F.col("mc")) - read_len // 2).alias("b"))
    pairs = left.join(rows.where("isize < 0").select("contig", "qname").distinct(), ["contig", "qname"], "left_semi").where("b >= a").select("contig", "a", (F.col("b") + 1).alias("b"))
    out = calls
    for side, at in (("left", "start"), ("right", "end")):
        out = depth_at(out, pairs, ["contig"], at, "a", "b", f"{side}_spanning")
    return out


def stable_with_mates(reads: DataFrame, least_mapq: int, least_clip: int) -> DataFrame:
    """Discordant reads with a stable end (side R or L) and their mates' sequences as those were read.

    Reads that are mapped no better than their mates give the sequences; a stable read finds its mate's by contig and key. A
    key that repeats counts once, by the latest record; sequences with N do not count."""
    from spanloom.functions.sequences import fastq_quality, fastq_sequence

    flag, same = F.col("flag"), P.is_same_contig(F.col("contig"), F.col("mate_contig"))
    mq = F.coalesce("mq", F.lit(0))
    rows = reads.where(P.is_primary(flag) & P.is_discordant(flag, F.col("contig"), F.col("mate_contig"), F.col("isize")) & ((F.col("mapq") >= least_mapq) | (mq >= least_mapq) | P.is_unmapped(flag)))
    given = rows.where((F.col("mapq") <= mq) | P.is_unmapped(flag)).select(
        F.coalesce("mate_contig", "contig").alias("at"), P.mate_key(F.col("qname"), flag, same).alias("key"), fastq_sequence(F.col("seq"), P.is_reverse(flag)).alias("mate_seq"), fastq_quality(F.col("qual"), P.is_reverse(flag)).alias("mate_qual"), "file_ord"
    )
    given = first_come(given, ["at", "key"], [F.desc("file_ord")]).where(~F.col("mate_seq").contains("N")).select("at", "key", "mate_seq", "mate_qual")
    stable = rows.withColumn("side", P.stable_end(flag, F.col("cigar"), F.col("mapq"), mq, least_clip)).where("side is not null")
    stable = stable.withColumns({"at": F.col("contig"), "key": P.mate_key(F.col("qname"), flag, same, own=False), "end": C.end_position(F.col("pos"), F.col("cigar"))})
    mate = {"mate_reverse": P.has(flag, P.MATE_REVERSE), "mate_mapped": ~P.is_mate_unmapped(flag)}
    return stable.withColumns(mate).join(given, ["at", "key"]).select("contig", "side", "qname", F.col("pos").alias("start"), "end", "mate_contig", "mate_pos", "nm", "mate_seq", "mate_qual", "seq", *mate)


def semi_mapped(clusters: DataFrame, pairs: DataFrame, max_is: int, width: int = 512) -> DataFrame:
    """Proper pairs whose mate lies within reach of a cluster, each given to the largest such cluster. clusters: id, contig,
    side, start, end, members; pairs: contig, qname, mate_start, mate_end.

    Of clusters with one reach only the first can get anything, and mates of one place have the same candidates; so a place meets
    at most max_is + 1 clusters, whatever lies there."""
    low = F.when(F.col("side") == "R", F.col("end") - max_is).otherwise(F.col("start"))
    outer = clusters.select(F.col("id").alias("cluster"), "contig", low.alias("low"), (low + max_is).alias("high"), "members")
    rank = [F.desc("members"), F.col("cluster")]
    outer, places = first_come(outer, ["contig", "low"], rank), pairs.select("contig", "mate_start", "mate_end").distinct()
    held = intervals_in_intervals(places, outer, ["contig"], "mate_start", "mate_end", "low", "high", width).drop("low", "high")
    held = first_come(held, ["contig", "mate_start", "mate_end"], rank)
    return first_come(pairs.join(held, ["contig", "mate_start", "mate_end"]), ["contig", "qname"], rank).select("cluster", "contig", "qname")


def matched_clusters(right: DataFrame, left: DataFrame, max_is: int) -> DataFrame:
    """One-to-one pairs of right and left clusters in reach, by the product of their members: r, l. Each right cluster offers
    only its largest partner; if that is taken it stays alone. Both: id, contig, start, end, members.

    Of left clusters at one place only the first can be a partner, and right ones at one place have the same, so a place meets at most
    2 * max_is + 1. As a right cluster has one offer, the matching in order of weight gives each left one its best."""
    a = right.select(F.col("id").cast("long").alias("r"), "contig", F.col("end").alias("at"), F.col("members").alias("rm"))
    b = left.select(F.col("id").cast("long").alias("l"), "contig", F.col("start").alias("at2"), F.col("members").alias("lm"))
    rank = [F.desc("lm"), F.col("at2"), F.col("l")]
    near = first_come(within_band(a.select("contig", "at").distinct(), first_come(b, ["contig", "at2"], rank), ["contig"], "at", "at2", max_is, max_is), ["contig", "at"], rank)
    offers = first_come(a.join(near, ["contig", "at"]), ["r"], rank)
    return first_come(offers, ["contig", "l"], [F.desc(F.col("rm") * F.col("lm")), F.col("r")]).select("contig", "r", "l")
