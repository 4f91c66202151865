"""Running totals, depth and exact order statistics that no single task has to hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions for each bin of a two-level running total.
BIN = 4096


def running_total(df: DataFrame, keys: list[str], at: str, value: str, name: str, width: int = BIN) -> DataFrame:
    """Adds the sum of `value` over rows of the same keys up to and including this row's `at` (a long).

    Rows are summed for each bin of positions first; only the bins' totals, of which there are few, are accumulated along a
    key, and rows only within their bin. So a key with very many rows is spread over tasks."""
    binned = df.withColumn("__rb", F.floor((F.col(at) - F.pmod(F.col(at), F.lit(width))) / width).cast("long"))
    totals = binned.groupBy(*keys, "__rb").agg(F.sum(value).alias("__rt"))
    before = Window.partitionBy(*keys).orderBy("__rb").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("__rp", F.coalesce(F.sum("__rt").over(before), F.lit(0))).drop("__rt")
    inside = Window.partitionBy(*keys, "__rb").orderBy(at)
    null_safe = F.lit(True)
    totals = totals.withColumnsRenamed({k: f"__k_{k}" for k in [*keys, "__rb"]})
    for k in [*keys, "__rb"]:
        null_safe = null_safe & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    joined = binned.join(totals, null_safe)
    return joined.withColumn(name, F.sum(value).over(inside) + F.col("__rp")).drop("__rb", "__rp", *[f"__k_{k}" for k in [*keys, "__rb"]])


def next_place(df: DataFrame, keys: list[str], at: str, name: str, width: int = BIN) -> DataFrame:
    """Adds the next larger `at` (a long) of the same keys, null for the last; rows are distinct in keys and `at`. In two levels,
    like running_total: rows within a bin, and the bins' first places along a key."""
    binned = df.withColumn("__nb", F.floor((F.col(at) - F.pmod(F.col(at), F.lit(width))) / width).cast("long"))
    heads = binned.groupBy(*keys, "__nb").agg(F.min(at).alias("__nf"))
    heads = heads.withColumn("__nn", F.lead("__nf").over(Window.partitionBy(*keys).orderBy("__nb"))).drop("__nf")
    heads = heads.withColumnsRenamed({k: f"__k_{k}" for k in [*keys, "__nb"]})
    same = F.lit(True)
    for k in [*keys, "__nb"]:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    inside = Window.partitionBy(*keys, "__nb").orderBy(at)
    joined = binned.join(heads, same).withColumn(name, F.coalesce(F.lead(at).over(inside), F.col("__nn")))
    return joined.drop("__nb", "__nn", *[f"__k_{k}" for k in [*keys, "__nb"]])


def depth_at(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, end: str, name: str = "depth") -> DataFrame:
    """Adds to each point the number of intervals [start, end) of its keys that cover it.

    Depth is the running total of +1 at starts and -1 at ends, so it takes one shuffle of ends and points instead of a join
    that makes a row for each pair."""
    solid = intervals.where(F.col(end) > F.col(start))
    one = F.lit(1).cast("long")
    events = solid.select(*keys, F.col(start).alias(at), one.alias("__d")).unionByName(solid.select(*keys, F.col(end).alias(at), (-one).alias("__d")))
    places = points.select(*keys, at).distinct().withColumn("__p", F.lit(True))
    steps = events.groupBy(*keys, at).agg(F.sum("__d").alias("__d")).join(places, [*keys, at], "full").fillna(0, ["__d"])
    depths = running_total(steps, keys, at, "__d", "__depth").where("__p").select(*keys, at, F.col("__depth").alias(name))
    return points.join(depths, [*keys, at], "left").fillna(0, [name])


def order_statistics(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Column], weight: str | None = None) -> DataFrame:
    """For each key n and the values at the given 0-based ranks of the sorted values (integers); `ranks` are expressions over n.

    Values are counted first, so that repeats cost nothing, and ranks are found in running counts of distinct values. Ranks
    beyond the last value give the last one. weight: how often a row counts."""
    whole = not keys
    if whole:
        df, keys = df.withColumn("__all", F.lit(True)), ["__all"]
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("long").alias("__v")).agg((F.count("*") if weight is None else F.sum(weight)).alias("__c"))
    upto = running_total(counts, keys, "__v", "__c", "__to")
    totals = counts.groupBy(*keys).agg(F.sum("__c").alias("n"))
    picks = []
    for name, rank in ranks.items():
        wanted = F.least(F.greatest(rank, F.lit(0)), F.col("n") - 1)
        picks.append(F.min(F.when(F.col("__to") > wanted, F.col("__v"))).alias(name))
    found = upto.join(totals, keys).groupBy(*keys, "n").agg(*picks)
    return found.drop("__all") if whole else found
