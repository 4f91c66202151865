"""Scores of the regions that a cluster pair's mates may come from, in both orientations.

Every step is a table over (cluster, region, rc, side, member): clips are placed first and set limits; reads are placed between them;
where a side's reads lie further apart than an insert is long, they are placed again in the best window of that length; limits
that clips did not set come from where most reads are clipped; what lies outside or is clipped elsewhere does not count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.align import DEFAULT, PERMISSIVE, Scoring, gaps_may_pay
from spanloom.functions.sequences import reverse_complement
from spanloom.operators.seeds import K, W, align_to_stretches, seed_index
from spanloom.shared import Scratch

#: The least score of a placed mate, the letters that make a clip, and how far from a limit a clipped one may end.
LEAST, LEAST_CLIP, NEAR = 30, 15, 5
_CASE = ["cluster", "region", "rc"]
_SIDE = [*_CASE, "side"]


def oriented(members: DataFrame) -> DataFrame:
    """members: cluster, side (R or L), member, clip, seq. Both orientations as rows, with q as it is to be placed: mates of the
    right-pointing side on the other strand, those of the left-pointing one as they are; with rc the other way round. Clips (rows
    whose seq is read along the reference already) are turned with rc only."""
    rc = members.withColumn("rc", F.explode(F.array(F.lit(False), F.lit(True))))
    turned = F.when(F.col("clip"), F.col("rc")).otherwise(F.col("rc") != (F.col("side") == "R"))
    return rc.withColumn("q", F.when(turned, reverse_complement(F.col("seq"))).otherwise(F.col("seq")))


def best_window(placed: DataFrame, keys: list[str], longest: int) -> DataFrame:
    """placed: keys, score, start, end. For each key the window of starts, `longest` long at most, with the largest sum of scores, the
    first of equals: from (its first start) and to (the largest end of a row with its last start)."""
    reach = Window.partitionBy(*keys).orderBy("start").rangeBetween(-longest, 0)
    sums = placed.select(*keys, "start", "end", F.sum("score").over(reach).alias("s"), F.min("start").over(reach).alias("from"))
    best = sums.groupBy(*keys).agg(F.min_by(F.struct("from", "start"), F.struct(-F.col("s"), "start")).alias("b"))
    ends = sums.join(best, keys).where(F.col("start") == F.col("b.start"))
    return ends.groupBy(*keys).agg(F.first("b.from").alias("from"), F.max("end").alias("to"))


def most_frequent(rows: DataFrame, keys: list[str], value: Column, name: str, first: bool) -> DataFrame:
    """The value that most rows have; of equals the smallest (first) or the largest."""
    counts = rows.groupBy(*keys, value.alias("__v")).agg(F.count("*").alias("__n"))
    tie = F.col("__v") if first else -F.col("__v")
    return counts.groupBy(*keys).agg(F.min_by("__v", F.struct(-F.col("__n"), tie)).alias(name))


def score_regions(
    members: DataFrame, regions: DataFrame, reference: DataFrame, longest: int, chunk: int, tables: Scratch, name: str = "", scoring: Scoring = DEFAULT, clip_scoring: Scoring = PERMISSIVE, least: int = LEAST, least_clip: int = LEAST_CLIP, k: int = K, w: int = W, index: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """members: as oriented() has them, at most one clip a side, whose member is any id; regions: cluster, region, contig, low, high.

    The scores: cluster, region, rc, total, accepted, reads, first, last (of the inserted sequence, on the contig; null without
    evidence at that end). And the members as placed: cluster, region, rc, side, member, clip, score, start, end, accepted.
    Members that do not align at all have no such row. Results are tables of `tables`."""
    index = seed_index(reference, chunk, k, w) if index is None else index
    rows = tables.table(oriented(members).select("cluster", "rc", "side", "member", "clip", "q"), f"{name}members")
    # Where no query is so long that a gap may pay, none needs seeds.
    longest_query = rows.agg(F.max(F.length("q"))).first()[0] or 0
    cases = regions.withColumn("rc", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("side", F.explode(F.array(F.lit("R"), F.lit("L"))))
    asked = rows.join(regions.select("cluster", "region"), "cluster")

    def put(stretches: DataFrame, queries: DataFrame, how: Scoring, table: str) -> DataFrame:
        found = align_to_stretches(stretches, queries.select(*_SIDE, "member", "clip", "q"), _SIDE, ["member", "clip"], reference, index if gaps_may_pay(longest_query, how) else None, chunk, how, k, w)
        flags = {"accepted": F.col("score") >= least, "left_clipped": F.col("left_clip") >= least_clip, "right_clipped": F.col("right_clip") >= least_clip}
        return tables.table(found.withColumns(flags).drop("left_clip", "right_clip"), f"{name}{table}")

    clips = put(cases.select(*_SIDE, "contig", "low", "high"), asked.where("clip"), clip_scoring, "clips")
    # Of the two sides the one that the orientation puts first sets where the region begins, the other where it ends.
    ahead = F.col("rc") == (F.col("side") == "L")
    good = clips.where("accepted").groupBy(*_CASE).agg(F.max(F.when(ahead, F.col("start"))).alias("__from"), F.max(F.when(~ahead, F.col("end"))).alias("__to"), F.sum("score").alias("clip_total"))
    limits = cases.join(good, _CASE, "left").withColumn("from", F.coalesce("__from", "low")).withColumn("to", F.coalesce("__to", "high"))
    limits = tables.table(limits.select(*_SIDE, "contig", "low", "high", "from", "to", F.coalesce("clip_total", F.lit(0)).alias("clip_total")), f"{name}limits")
    reads = put(limits.select(*_SIDE, "contig", F.col("from").alias("low"), F.col("to").alias("high")), asked.where("not clip"), scoring, "reads")

    wide = reads.groupBy(*_SIDE).agg((F.max("end") - F.min("start")).alias("__w")).where(F.col("__w") > longest).drop("__w")
    window = best_window(reads.join(wide, _SIDE, "left_semi"), _SIDE, longest).withColumnsRenamed({"from": "a", "to": "b"})
    window = window.join(limits, _SIDE).join(clips.select(*_SIDE, F.lit(True).alias("__clip")).unionByName(asked.where("clip").select(*_SIDE, F.lit(True).alias("__clip"))).distinct(), _SIDE, "left")
    room = F.when(F.col("__clip"), F.greatest(longest - (F.col("b") - F.col("a")), F.lit(0))).otherwise(0)
    again = window.select(*_SIDE, "contig", F.when(ahead, F.greatest(F.col("a") - room, F.least("a", "from"))).otherwise(F.col("a")).alias("low"), F.when(~ahead, F.least(F.col("b") + room, F.greatest("b", "to"))).otherwise(F.col("b")).alias("high"))
    again = tables.table(again, f"{name}windows")
    moved = put(again, asked.join(again.select(*_SIDE), _SIDE, "left_semi"), scoring, "again")
    old = reads.unionByName(clips).join(again.select(*_SIDE), _SIDE, "left_anti")
    placed = tables.table(old.unionByName(moved), f"{name}placed")

    inside = placed.where("not clip")
    modes = limits.groupBy(*_CASE).agg(F.first("low").alias("low"), F.first("high").alias("high"), F.first("from").alias("from"), F.first("to").alias("to"), F.first("clip_total").alias("clip_total"))
    modes = modes.join(most_frequent(inside.where("left_clipped"), _CASE, F.col("start"), "__ms", True), _CASE, "left").join(most_frequent(inside.where("right_clipped"), _CASE, F.col("end"), "__me", False), _CASE, "left")
    low = F.when(F.col("from") == F.col("low"), F.coalesce("__ms", "from")).otherwise(F.col("from"))
    high = F.when(F.col("to") == F.col("high"), F.coalesce("__me", "to")).otherwise(F.col("to"))
    modes = tables.table(modes.select(*_CASE, low.alias("from"), high.alias("to"), "clip_total"), f"{name}modes")
    wrong = (F.col("left_clipped") & (F.col("from") < F.col("start") - NEAR)) | (F.col("end") < F.col("from")) | (F.col("right_clipped") & (F.col("end") + NEAR < F.col("to"))) | (F.col("to") < F.col("start"))
    judged = placed.join(modes, _CASE).withColumn("accepted", F.col("accepted") & (F.col("clip") | ~wrong))
    judged = tables.table(judged.select(*_SIDE, "member", "clip", "score", "start", "end", "accepted"), f"{name}judged")

    ok = F.col("accepted")
    ends = judged.groupBy(*_SIDE).agg(
        F.coalesce(F.min(F.when(ok & F.col("clip"), F.col("start"))), F.min(F.when(ok, F.col("start")))).alias("s"), F.coalesce(F.max(F.when(ok & F.col("clip"), F.col("end"))), F.max(F.when(ok, F.col("end")))).alias("e"),
        F.coalesce(F.sum(F.when(ok & ~F.col("clip"), F.col("score"))), F.lit(0)).alias("t"), F.count_if(ok & ~F.col("clip")).alias("n"),
    )
    whole = ends.groupBy(*_CASE).agg(F.max(F.when(ahead, F.col("s"))).alias("first"), F.max(F.when(~ahead, F.col("e"))).alias("last"), F.sum("t").alias("t"), F.sum("n").alias("accepted"))
    counts = members.groupBy("cluster").agg(F.count_if(~F.col("clip")).alias("reads"))
    scores = modes.join(whole, _CASE, "left").join(counts, "cluster").select(*_CASE, (F.coalesce("t", F.lit(0)) + F.col("clip_total")).alias("total"), F.coalesce("accepted", F.lit(0)).alias("accepted"), "reads", "first", "last")
    return tables.table(scores, f"{name}scores"), judged


def best_regions(scores: DataFrame, regions: DataFrame, most: int = 1) -> DataFrame:
    """The better orientation of each region (as given, where equal), and of a cluster's regions the `most` best: by total, then the
    shorter one, then contig and place. Adds contig, low, high and rank from 1."""
    turn = scores.groupBy("cluster", "region").agg(F.min_by(F.struct("rc", "total", "accepted", "reads", "first", "last"), F.struct(-F.col("total"), "rc")).alias("b")).select("cluster", "region", "b.*")
    order = Window.partitionBy("cluster").orderBy(F.desc("total"), F.col("high") - F.col("low"), "contig", "low", "region")
    return turn.join(regions, ["cluster", "region"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
