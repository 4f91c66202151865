"""Sampling statistics: insert sizes, pairs that cross positions, limits for each window, random positions."""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.intervals import points_in_intervals
from spanloom.operators.running import depth_at, order_statistics

#: Bases for each sampled position; what is kept off at both ends of a contig.
SPACING, MARGIN = 1000, 1000


@dataclass(frozen=True)
class Region:
    contig: str
    start: int
    end: int


def random_positions(regions: list[Region], seed: int) -> list[tuple[str, int]]:
    """One position for each SPACING bases of the regions, drawn with a seeded generator by their lengths. Small: a driver list."""
    draw = random.Random(seed)
    total = sum(r.end - r.start for r in regions)
    out = []
    for _ in range(1, total // SPACING):
        at = draw.randint(0, total - 1)
        for r in regions:
            if at < r.end - r.start:
                out.append((r.contig, r.start + at))
                break
            at -= r.end - r.start
    return out


def whole_contigs(lengths: dict[str, int]) -> list[Region]:
    return [Region(c, MARGIN, n - MARGIN) for c, n in lengths.items() if n > 2 * MARGIN]


def offsets_to_regions(offsets: DataFrame, regions: DataFrame, at: str, order: str, length: str, region_id: str, width: int) -> DataFrame:
    """Adds to each offset into the regions laid end to end its region and the place in it: a join on the running total of
    lengths. Offsets beyond the total are left out."""
    upto = Window.orderBy(order)  # regions are few: a row for each contig or listed region
    laid = regions.select(F.col(region_id), F.col(length).cast("long").alias("__n"), F.sum(F.col(length).cast("long")).over(upto).alias("__e"))
    laid = laid.select(region_id, (F.col("__e") - F.col("__n")).alias("__s"), "__e")
    return points_in_intervals(offsets, laid, [], at, "__s", "__e", width).withColumn("place", F.col(at) - F.col("__s")).drop("__s", "__e")


def insert_size_model(sizes: DataFrame, value: str) -> DataFrame:
    """One row: mean, low and high spread (whole numbers) and the bounds min_is and max_is.

    Values five deviations or more from the mean are left out; then the mean is cut to a whole number and the spread taken
    on each side of it."""
    x = F.col(value).cast("double")
    first = sizes.agg(F.avg(x).alias("__m"), F.stddev_pop(x).alias("__d"))
    trimmed = sizes.select(x.alias("__x")).join(F.broadcast(first)).where(F.abs(F.col("__x") - F.col("__m")) < 5 * F.col("__d"))  # one row
    mean = trimmed.agg(F.avg("__x").alias("__c"))
    centred = trimmed.select("__x").join(F.broadcast(mean))  # one row
    gap = F.col("__c") - F.col("__x")
    side = lambda low: F.sqrt(F.avg(F.when(gap > 0 if low else gap < 0, gap * gap)))
    found = centred.agg(F.max("__c").alias("c"), side(True).alias("lo"), side(False).alias("hi"))
    whole = found.select(F.col("c").cast("long").alias("avg_is"), F.coalesce(F.col("lo").cast("long"), F.lit(0).cast("long")).alias("low"), F.coalesce(F.col("hi").cast("long"), F.lit(0).cast("long")).alias("high"))
    return whole.select("avg_is", "low", "high", (F.col("avg_is") - 3 * F.col("low")).alias("min_is"), (F.col("avg_is") + F.floor(3.5 * F.col("high"))).cast("long").alias("max_is"))


def limit_per_window(df: DataFrame, window: list[str], order: list, most: int) -> DataFrame:
    """The first rows of each window, with their place in it; Spark cuts each task's share before the shuffle."""
    w = Window.partitionBy(*window).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def head_max(df: DataFrame, order: list, value: Column, rows: int = 1001) -> DataFrame:
    """One row, `most`: the largest value among the first rows. Spark keeps the first rows of each task only."""
    return df.orderBy(*order).limit(rows).agg(F.max(value).alias("most"))


def average_depth(points: DataFrame, reads: DataFrame, keys: list[str], at: str, start: str, end: str) -> DataFrame:
    """One row, `average`: reads that begin before a position and reach over it, by position."""
    inner = reads.select(*keys, (F.col(start) + 1).alias("__s"), F.col(end).alias("__e"))
    return depth_at(points, inner, keys, at, "__s", "__e", "__depth").agg((F.sum("__depth").cast("double") / F.count("*")).alias("average"))


def cap_windows(df: DataFrame, window: list[str], most: int) -> DataFrame:
    """The rows of the first windows, in order of their keys, up to and with the one that brings the total to `most`: the cap is
    looked at between windows. Only the windows' sizes, one row each, are added up in order."""
    sizes = df.groupBy(*window).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy(*window).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = sizes.withColumn("__before", before).where(F.col("__before") < most).select(*window)
    return df.join(kept, window, "left_semi")


def crossing_counts(points: DataFrame, pairs: DataFrame, keys: list[str], at: str, start: str, end: str, largest: int, width: int) -> DataFrame:
    """For each distinct position and each distance up to `largest`: how many pairs with start <= at < end end that far beyond it
    (keys, at, size, pairs).

    Pairs with one end are counted by their starts, and a running count of these is one segment between two starts; so a
    position meets at most `largest` segments, whatever the number of pairs around it."""
    near = pairs.select(*keys, F.greatest(F.col(start), F.col(end) - largest).alias("__a"), F.col(end).alias("__b")).where("__b > __a")
    counts = near.groupBy(*keys, "__b", "__a").agg(F.count("*").alias("__c"))
    w = Window.partitionBy(*keys, "__b").orderBy("__a")
    runs = counts.withColumns({"pairs": F.sum("__c").over(w), "__z": F.coalesce(F.lead("__a").over(w), F.col("__b"))}).drop("__c")
    found = points_in_intervals(points.select(*keys, at).distinct(), runs, keys, at, "__a", "__z", width)
    return found.select(*keys, at, (F.col("__b") - F.col(at)).alias("size"), "pairs")


def pairs_by_size(crossing: DataFrame, position: list[str], size: str, count: str, weights: DataFrame, largest: int) -> DataFrame:
    """For each size 0..largest the count, over positions with a pair, of pairs up to that size, at rank n div 200.

    crossing: a row for each position and distance with the number of pairs; weights: position and `weight`, how often it counts.
    Only sizes at which a position's count changes are rows at first; the dense grid is positions times sizes, which the sampled
    positions bound."""
    kept = crossing.where(F.col(size).between(0, largest)).groupBy(*position, F.col(size).cast("long").alias("size")).agg(F.sum(count).alias("c"))
    w = Window.partitionBy(*position).orderBy("size")
    steps = kept.withColumn("upto", F.sum("c").over(w)).withColumn("next", F.coalesce(F.lead("size").over(w), F.lit(largest + 1).cast("long")))
    first = kept.groupBy(*position).agg(F.min("size").alias("f")).where("f > 0").select(*position, F.explode(F.sequence(F.lit(0).cast("long"), F.col("f") - 1)).alias("size"), F.lit(0).cast("long").alias("upto"))
    grid = steps.select(*position, F.explode(F.sequence(F.col("size"), F.col("next") - 1)).alias("size"), "upto").unionByName(first)
    weighted = grid.join(weights, position)
    return order_statistics(weighted, ["size"], "upto", {"min_pairs": F.expr("n div 200")}, weight="weight").select("size", "min_pairs")


def default_lookup(stats: DataFrame, wanted: DataFrame, contig: str, default: str = ".") -> DataFrame:
    """Adds `value` of the contig's own row, or of the default's where it has none; null without either. stats: contig (once each), value."""
    own = stats.select(F.col("contig").alias("__c"), F.col("value").alias("__own"))
    rest = stats.where(F.col("contig") == default).agg(F.max("value").alias("__rest"))  # one row, also without a default
    return wanted.join(own, F.col(contig) == F.col("__c"), "left").join(F.broadcast(rest)).withColumn("value", F.coalesce("__own", "__rest")).drop("__c", "__own", "__rest")
