"""Coverage of intervals and pairs that span positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.intervals import overlapping
from spanloom.operators.running import next_place, order_statistics, running_total


def median_covered(targets: DataFrame, reads: DataFrame, keys: list[str], target_id: list[str], low: str, high: str, start: str, end: str, width: int) -> DataFrame:
    """For each target [low, high) the depths of its positions in falling order, at the place (number of covered ones) div 2:
    target_id, covered, median. A target that nothing covers gets 0.

    Depth is a running total of +1 at starts and -1 at ends along the keys; between two such places it is one segment, whatever
    the number of reads, and targets are joined with segments. Positions with equal depth are one row with a weight, so that
    neither reads nor positions are multiplied out."""
    one = F.lit(1).cast("long")
    solid = reads.where(F.col(end) > F.col(start))
    ends = solid.select(*keys, F.col(start).alias("__s"), one.alias("__d")).unionByName(solid.select(*keys, F.col(end).alias("__s"), (-one).alias("__d")))
    depths = running_total(ends.groupBy(*keys, "__s").agg(F.sum("__d").alias("__d")), keys, "__s", "__d", "__depth")
    # a bin's last place goes on to the first of the key's next bin that has one: both are known from the bins' bounds
    depths = next_place(depths.select(*keys, "__s", "__depth"), keys, "__s", "__e").where("__depth > 0")
    wanted = targets.select(*keys, *target_id, F.col(low).alias("__l"), F.col(high).alias("__h"))
    pairs = overlapping(wanted, depths, keys, "__l", "__h", "__s", "__e", width)
    runs = pairs.select(*target_id, "__depth", (F.least("__h", "__e") - F.greatest("__l", "__s")).alias("__n"))
    runs = runs.groupBy(*target_id, "__depth").agg(F.sum("__n").alias("__n"))
    down = Window.partitionBy(*target_id).orderBy(F.desc("__depth"))
    upto = runs.withColumn("__to", F.sum("__n").over(down)).withColumn("covered", F.sum("__n").over(Window.partitionBy(*target_id)))
    # the covered positions come first in falling order, so the place lies among them
    median = upto.groupBy(*target_id, "covered").agg(F.max(F.when(F.col("__to") > F.expr("covered div 2"), F.col("__depth"))).alias("median"))
    return targets.select(*target_id).join(median, target_id, "left").fillna(0, ["covered", "median"])


def spanning_pairs(targets: DataFrame, pairs: DataFrame, keys: list[str], target_id: list[str], at: str, start: str, end: str, width: int) -> DataFrame:
    """Adds to each target the number of pairs whose inner span [start, end] contains its position."""
    from spanloom.operators.running import depth_at

    closed = pairs.select(*keys, F.col(start).alias("__s"), (F.col(end) + 1).alias("__e"))
    return depth_at(targets, closed, keys, at, "__s", "__e", "spanning")


def quality_percentile(df: DataFrame, value: str) -> DataFrame:
    """The first bin (value rounded half up) at which the running count reaches a hundredth of all: one row, `bin`."""
    bins = df.select(F.floor(F.col(value) + 0.5).cast("long").alias("bin"))
    found = order_statistics(bins, [], "bin", {"bin": F.greatest(F.expr("n div 100") - 1, F.lit(0))})
    return found.select(F.when(F.col("n") < 100, F.lit(0).cast("long")).otherwise(F.col("bin")).alias("bin"))
