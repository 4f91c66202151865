"""Joins on intervals. Each becomes an equi-join on bins with the exact condition as residual, so that it shuffles on keys
and can be split where skewed, instead of comparing everything with everything.

Intervals are half-open [start, end) over longs unless said otherwise. Clashing column names are the caller's to avoid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bin(value: Column, width: int) -> Column:
    """Floor division, also below zero, in integers."""
    return F.floor((value - F.pmod(value, F.lit(width))) / width).cast("long") if width > 1 else value.cast("long")


def _bins(start: Column, last: Column, width: int) -> Column:
    """All bins that [start, last] touches; none if it is empty."""
    return F.when(last >= start, F.sequence(_bin(start, width), _bin(last, width))).otherwise(F.array().cast("array<bigint>"))


def _pack(df: DataFrame, name: str, **extra: Column) -> DataFrame:
    return df.select(F.struct(*df.columns).alias(name), *[c.alias(k) for k, c in extra.items()])


def points_in_intervals(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, end: str, width: int, how: str = "inner") -> DataFrame:
    """Pairs of a point and an interval of the same keys with start <= at < end. Each point has one bin, so pairs come once.

    how: inner, left (all points), left_semi or left_anti (points only)."""
    left = points.withColumn("__bin", _bin(F.col(at), width))
    right = intervals.withColumnsRenamed({k: f"__{k}" for k in keys}).withColumn("__bin_", F.explode(_bins(F.col(start), F.col(end) - 1, width)))
    condition = (F.col("__bin") == F.col("__bin_")) & (F.col(start) <= F.col(at)) & (F.col(at) < F.col(end))
    for k in keys:
        condition &= F.col(k) == F.col(f"__{k}")
    return left.join(right, condition, how).drop("__bin", "__bin_", *[f"__{k}" for k in keys])


def intervals_in_intervals(inner: DataFrame, outer: DataFrame, keys: list[str], start: str, end: str, low: str, high: str, width: int, how: str = "inner") -> DataFrame:
    """Pairs where [start, end] lies within [low, high] (closed): as above with the inner one's start as the point."""
    left = inner.withColumn("__bin", _bin(F.col(start), width))
    right = outer.withColumnsRenamed({k: f"__{k}" for k in keys}).withColumn("__bin_", F.explode(_bins(F.col(low), F.col(high), width)))
    condition = (F.col("__bin") == F.col("__bin_")) & (F.col(low) <= F.col(start)) & (F.col(end) <= F.col(high))
    for k in keys:
        condition &= F.col(k) == F.col(f"__{k}")
    return left.join(right, condition, how).drop("__bin", "__bin_", *[f"__{k}" for k in keys])


def contained_counts(inner: DataFrame, outer: DataFrame, keys: list[str], start: str, end: str, low: str, high: str, width: int, count: str = "n") -> DataFrame:
    """Pairs of distinct intervals of which [start, end] lies within [low, high] (closed), with the number of inner rows that are equal.

    Very many reads and windows at few places are so compared once for each pair of places; what belongs to a window alone, or to a read
    alone, is joined to its own rows afterwards."""
    few = inner.groupBy(*keys, start, end).agg(F.count("*").alias(count))
    return intervals_in_intervals(few, outer.select(*keys, low, high).distinct(), keys, start, end, low, high, width)


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], start: str, end: str, start2: str, end2: str, width: int) -> DataFrame:
    """Pairs of overlapping intervals. Both sides are binned; a pair counts in the bin where the later of them starts."""
    a = left.withColumn("__bin", F.explode(_bins(F.col(start), F.col(end) - 1, width)))
    b = right.withColumnsRenamed({k: f"__{k}" for k in keys}).withColumn("__bin_", F.explode(_bins(F.col(start2), F.col(end2) - 1, width)))
    condition = (F.col("__bin") == F.col("__bin_")) & (F.col(start) < F.col(end2)) & (F.col(start2) < F.col(end))
    condition &= F.col("__bin") == _bin(F.greatest(start, start2), width)
    for k in keys:
        condition &= F.col(k) == F.col(f"__{k}")
    return a.join(b, condition).drop("__bin", "__bin_", *[f"__{k}" for k in keys])


def overlaps_any(left: DataFrame, right: DataFrame, keys: list[str], start: str, end: str, start2: str, end2: str, anti: bool = False) -> DataFrame:
    """The left intervals that overlap some right one, or (anti) none.

    An interval [s, e) overlaps some [s2, e2) exactly if fewer of those end by s than start before e; both counts come from
    one sorted pass over the ends, so a place that very many intervals cover costs no more than any other."""
    from spanloom.operators.running import running_total

    solid = F.col(end2) > F.col(start2)
    events = right.where(solid).select(*keys, F.col(start2).alias("__at"), F.lit(1).cast("long").alias("__s"), F.lit(0).cast("long").alias("__e"))
    events = events.unionByName(right.where(solid).select(*keys, F.col(end2).alias("__at"), F.lit(0).cast("long").alias("__s"), F.lit(1).cast("long").alias("__e")))
    asked = left.select(*keys, (F.col(end) - 1).alias("__at")).unionByName(left.select(*keys, F.col(start).alias("__at"))).distinct()
    events = events.groupBy(*keys, "__at").agg(F.sum("__s").alias("__s"), F.sum("__e").alias("__e"))
    every = events.join(asked, [*keys, "__at"], "full").fillna(0, ["__s", "__e"])
    counts = running_total(running_total(every, keys, "__at", "__s", "__starts"), keys, "__at", "__e", "__ends").select(*keys, "__at", "__starts", "__ends")
    by_end = counts.select(*keys, F.col("__at").alias("__last"), "__starts")
    by_start = counts.select(*keys, F.col("__at").alias("__first"), "__ends")
    joined = left.withColumn("__last", F.col(end) - 1).withColumn("__first", F.col(start)).join(by_end, [*keys, "__last"], "left").join(by_start, [*keys, "__first"], "left")
    found = (F.col(end) > F.col(start)) & (F.coalesce("__starts", F.lit(0)) > F.coalesce("__ends", F.lit(0)))
    return joined.where(~found if anti else found).select(*left.columns)


def within_band(left: DataFrame, right: DataFrame, keys: list[str], at: str, at2: str, below: int, above: int) -> DataFrame:
    """Pairs with at - below <= at2 <= at + above. The right side has one bin, the left the few that its band touches."""
    width = max(1, below + above)
    a = left.withColumn("__bin", F.explode(_bins(F.col(at) - below, F.col(at) + above, width)))
    b = right.withColumnsRenamed({k: f"__{k}" for k in keys}).withColumn("__bin_", _bin(F.col(at2), width))
    condition = (F.col("__bin") == F.col("__bin_")) & F.col(at2).between(F.col(at) - below, F.col(at) + above)
    for k in keys:
        condition &= F.col(k) == F.col(f"__{k}")
    return a.join(b, condition).drop("__bin", "__bin_", *[f"__{k}" for k in keys])
