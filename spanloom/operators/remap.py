"""The discordant path's operators on clusters and on the regions to which their mates may belong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.alignments import may_merge
from spanloom.operators.intervals import within_band

#: Shares from which a cluster's own region explains its mates, and below which assembly is tried.
OWN_REGION, MOST_UNEXPLAINED = 0.95, 0.5


def cluster_bounds(direction: Column, read_start: Column, read_end: Column, clip_start: Column, clip_end: Column) -> tuple[Column, Column]:
    """Start and end of a cluster from the extent of its reads and of its best clip (null without one): on the side of its
    direction a clip alone decides."""
    start = F.when((direction == "L") & clip_start.isNotNull(), clip_start).otherwise(F.least(read_start, clip_start))
    end = F.when((direction == "R") & clip_end.isNotNull(), clip_end).otherwise(F.greatest(read_end, clip_end))
    return start, end


def best_by(df: DataFrame, keys: list[str], score: str, order: list[str], columns: list[str]) -> DataFrame:
    """For each key the columns of the row with the largest score, the first of equals in `order`, in one aggregation."""
    rank = F.struct((-F.col(score)).alias("s"), *order)
    return df.groupBy(*keys).agg(F.min_by(F.struct(*columns), rank).alias("__b")).select(*keys, "__b.*")


def mate_regions(reads: DataFrame, keys: list[str], mate_at: str, mate_reverse: str, length: str, most_insert: int, most_moved: int) -> DataFrame:
    """keys, low, high: where the inserted sequence of a subcluster may come from, by its leftmost reverse mate and its rightmost
    forward one, cut to the contig (`length`, the same in all rows of a key)."""
    back, forward = F.min(F.when(F.col(mate_reverse), F.col(mate_at))), F.max(F.when(~F.col(mate_reverse), F.col(mate_at)))
    found = reads.groupBy(*keys).agg(back.alias("b"), forward.alias("f"), F.first(length).alias("n"))
    low = F.least(F.col("b") - most_insert, F.col("f") - most_moved)
    high = F.greatest(F.col("b") + most_moved, F.col("f") + most_insert)
    return found.select(*keys, F.greatest(low, F.lit(0)).alias("low"), F.least(high, F.col("n")).alias("high"))


def region_scores(remaps: DataFrame, keys: list[str]) -> DataFrame:
    """remaps: keys, accepted, score, start, end, clip (whether the row is the cluster's clip). For each key: total, accepted, reads
    (clips aside), share, and first and last, where clips, if accepted, go before reads."""
    ok, clip = F.col("accepted"), F.col("accepted") & F.col("clip")
    first = F.coalesce(F.min(F.when(clip, F.col("start"))), F.min(F.when(ok, F.col("start"))))
    last = F.coalesce(F.max(F.when(clip, F.col("end"))), F.max(F.when(ok, F.col("end"))))
    found = remaps.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(ok, F.col("score"))), F.lit(0)).alias("total"), F.count_if(ok).alias("accepted"), F.count_if(~F.col("clip")).alias("reads"), first.alias("first"), last.alias("last")
    )
    return found.withColumn("share", F.try_divide(F.col("accepted").cast("double"), F.col("reads")))


def explained_by_own_region(own_total: Column, best_total: Column, accepted: Column, reads: Column) -> Column:
    """The cluster's own region scores nearly as well as the best one and takes half of the reads: no call."""
    return (own_total >= best_total * OWN_REGION) & F.coalesce(F.try_divide(accepted.cast("double"), reads) >= 0.5, F.lit(False))


def wants_assembly(right_accepted: Column, left_accepted: Column, reads: Column) -> Column:
    share = F.try_divide((right_accepted + left_accepted).cast("double"), reads)
    return (right_accepted == 0) | (left_accepted == 0) | F.coalesce(share < MOST_UNEXPLAINED, F.lit(False))


def merge_candidates(clusters: DataFrame, keys: list[str], identity: str, most: int) -> DataFrame:
    """Pairs (a, b, distance) of clusters that may merge, a starting first (of equal starts the smaller identity): a band join on
    starts, as the union of two is never shorter than their distance. clusters: keys, identity, dir, start, end, clips."""
    names = ["start", "end", "clips", identity]
    left = clusters.select(*keys, "dir", *[F.col(c).alias(f"a_{c}") for c in names])
    right = clusters.select(*keys, "dir", *[F.col(c).alias(f"b_{c}") for c in names])
    near = within_band(left, right.withColumnRenamed("dir", "dir2"), keys, "a_start", "b_start", 0, most).where("dir = dir2")
    first = (F.col("a_start") < F.col("b_start")) | ((F.col("a_start") == F.col("b_start")) & (F.col(f"a_{identity}") < F.col(f"b_{identity}")))
    c = {n: F.col(n) for n in near.columns}
    fits = may_merge(c["dir"], c["a_start"], c["a_end"], c["a_clips"], c["b_start"], c["b_end"], c["b_clips"], most)
    distance = F.greatest("a_end", "b_end") - F.least("a_start", "b_start")
    return near.where(first & fits).select(F.col(f"a_{identity}").alias("a"), F.col(f"b_{identity}").alias("b"), distance.alias("distance"))


def sweep_overlaps(alignments: DataFrame, keys: list[str], identity: str, start: str, end: str, least: int, longest: int) -> DataFrame:
    """Pairs (a, b, overlap) of a key's alignments, b not before a, with end of a - start of b >= least: the edges of a graph along
    the reference, which cannot have a cycle. longest: the bound on an alignment's length that makes it a band join."""
    left = alignments.select(*keys, F.col(identity).alias("a"), F.col(start).alias("__s"), F.col(end).alias("__e"))
    right = alignments.select(*keys, F.col(identity).alias("b"), F.col(start).alias("__s2"))
    near = within_band(left, right, keys, "__s", "__s2", 0, longest)
    later = (F.col("__s2") > F.col("__s")) | ((F.col("__s2") == F.col("__s")) & (F.col("b") > F.col("a")))
    overlap = F.col("__e") - F.col("__s2")
    return near.where(later & (overlap >= least)).select(*keys, "a", "b", overlap.alias("overlap"))


def retain_disjoint(df: DataFrame, keys: list[str], start: str, end: str, order: list[str]) -> DataFrame:
    """The rows of each key that overlap (ends count) none retained before them in `order`, which should be total. A key's rows are
    the few assembled sequences of one cluster pair, bounded as their reads are; they are held as one row."""
    rank = df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    entry = F.struct("__k", F.col(start).alias("s"), F.col(end).alias("e"), F.struct(*df.columns).alias("row"))
    free = lambda kept, x: ~F.exists(kept, lambda y: (F.greatest(x["s"], y["s"]) <= F.least(x["e"], y["e"])))
    fold = lambda rows: F.aggregate(rows, F.filter(rows, lambda x: F.lit(False)), lambda kept, x: F.when(free(kept, x), F.array_append(kept, x)).otherwise(kept))
    held = rank.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("__rows"))
    return held.select(F.explode(fold(F.col("__rows"))).alias("__r")).select("__r.row.*")


def update_mates(reads: DataFrame, contig: Column, at: Column, reverse: Column, cigar: Column, score: Column, accepted: Column) -> DataFrame:
    """The reads with their mates' fields as remapped: mate_contig, mate_pos, the mate-reverse bit of flag, mate_cigar, ok and ms."""
    bit = F.lit(0x20)
    flag = F.when(reverse, F.col("flag").bitwiseOR(bit)).otherwise(F.col("flag").bitwiseAND(F.bitwise_not(bit)))
    return reads.withColumns({"mate_contig": contig, "mate_pos": at, "flag": flag, "mate_cigar": cigar, "ok": F.when(accepted, "T").otherwise("F"), "ms": score})


def clamped_lookup(table: DataFrame, wanted: DataFrame, size: str, value: str, largest: int, last: Column) -> DataFrame:
    """Adds `value` of the row of `table` (size, value) with the row's size, or with the largest one beyond it or where `last` holds.
    The table has a row for each size up to `largest`."""
    at = F.when(last, F.lit(largest)).otherwise(F.least(F.col(size), F.lit(largest))).cast("long")
    own = table.select(F.col("size").cast("long").alias("__size"), F.col(value))
    return wanted.withColumn("__at", at).join(own, F.col("__at") == F.col("__size"), "left").drop("__at", "__size")
