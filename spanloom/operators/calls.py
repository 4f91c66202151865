"""Turning candidate insertions into calls: deduplication, identifiers, support, filters, suppression, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.shared import Scratch

#: A filtered pair's share of positive evidence below which it scores low, and the longest microhomology.
LEAST_SCORE, MOST_MICROHOMOLOGY = 0.25, 100


def keep_first(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row for each key: the first in this order, which should be total."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def sequential_ids(df: DataFrame, order: list[str], prefix: str, name: str = "id") -> DataFrame:
    """Adds prefix0, prefix1, … in this order, which should be total.

    Rows are sorted by range into partitions, which are written to the shared folder once, as a plan with two such exchanges may
    sample two different sets of bounds; each partition's rows are numbered on their own and shifted by the sizes of those
    before, of which there is one number a partition. Ties at partition bounds need the order to be total."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id())
    ranged = ranged.withColumns({"__part": F.shiftright("__m", 33).cast("int"), "__row": F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))}).drop("__m")
    ranged = Scratch(spark, "ids").table(ranged, "ranged")
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__c"))
    before = sizes.select(F.col("__part").alias("__p"), (F.sum("__c").over(Window.orderBy("__part")) - F.col("__c")).alias("__b"))
    joined = ranged.join(F.broadcast(before), F.col("__part") == F.col("__p"))  # a row for each partition
    return joined.withColumn(name, F.concat(F.lit(prefix), (F.col("__row") + F.col("__b")).cast("string"))).drop("__part", "__row", "__p", "__b")


def support(positive: list[Column], negative: Column) -> tuple[Column, Column]:
    """The sum of the evidence, and its share of all evidence (null without any)."""
    total = positive[0]
    for p in positive[1:]:
        total = total + p
    return total, F.try_divide(total.cast("double"), total + negative)


def filters(named: dict[str, Column]) -> Column:
    """array<string> of the names whose condition holds; PASS if none does. A null condition does not hold."""
    found = F.array_remove(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)).otherwise("") for n, c in named.items()]), "")  # compiled, unlike a lambda
    return F.when(F.size(found) == 0, F.array(F.lit("PASS"))).otherwise(found)


def insertion_filters(kind: str, c: dict[str, Column], least_size: int, read_length: int) -> Column:
    """The filters of small (S), transposed (T) and assembled (A) insertions. c: the columns and statistics by name."""
    size = c["length"] - (c["end"] - c["start"])
    half = F.when(F.instr(c["seq"], "-") > 1, F.split_part(c["seq"], F.lit("-"), F.lit(1))).otherwise(F.regexp_replace(c["seq"], "^-", ""))
    from spanloom.functions.sequences import is_homopolymer

    out = {
        "SMALL": (size >= 0) & (size < least_size),  # a replaced stretch longer than the insertion is only ALT_SHORTER_THAN_REF
        "ALT_SHORTER_THAN_REF": c["end"] - c["start"] >= c["length"],
        "ANOMALOUS_DEPTH": (F.greatest(c["left_depth"], c["right_depth"]) > c["max_depth"]) | (F.least(c["left_depth"], c["right_depth"]) < c["min_depth"]),
        "HOMOPOLYMER_INSSEQ": is_homopolymer(half),
    }
    if kind in "ST":
        out["ANOMALOUS_SC_NUMBER"] = F.greatest(c["left_split"], c["right_split"]) > c["global_max_depth"]
    if kind in "TA":
        out["NO_DISC_SUPPORT"] = c["left_disc"] + c["right_disc"] == 0
        low = (c["left_support"] < F.floor(c["median_depth"] / 5)) & (c["right_support"] < F.floor(c["median_depth"] / 5))
        out["LOW_SUPPORT"] = ~out["NO_DISC_SUPPORT"] & low
    if kind == "T":
        out["LOW_SCORE"] = F.coalesce((c["left_score"] < LEAST_SCORE) & (c["right_score"] < LEAST_SCORE), F.lit(False))
        out["MH_TOO_LONG"] = c["mh_len"] > MOST_MICROHOMOLOGY
    if kind in "TA":
        out["NOT_ENOUGH_DISC_PAIRS"] = c["left_disc"] + c["right_disc"] < c["min_pairs"]
    if kind == "A":
        cut = F.instr(c["seq"], "-")
        out["LOW_QUAL_ASSEMBLY"] = (cut > 0) & (cut - 1 < read_length) & (F.length(c["seq"]) - cut < read_length)
    return filters(out)


def compatible(contig: Column, contig2: Column, start: Column, start2: Column, end: Column, end2: Column, length: Column, length2: Column, most: Column | int) -> Column:
    """Calls that may be the same event."""
    return (contig == contig2) & (F.abs(start - start2) + F.abs(end - end2) <= most) & (F.abs(length - length2) <= most)


def suppress(df: DataFrame, by: DataFrame, contig: str, start: str, end: str, length: str, most: int) -> DataFrame:
    """The calls with no compatible call in `by` (which has the same column names).

    Compatible starts are at most `most` apart, so a call meets only those of its own and the neighbouring bins."""
    width = max(1, most)
    bin_ = lambda c: F.floor((c - F.pmod(c, F.lit(width))) / width).cast("long")
    left = df.withColumn("__bin", bin_(F.col(start)))
    right = by.select(F.col(contig).alias("__c"), F.col(start).alias("__s"), F.col(end).alias("__e"), F.col(length).alias("__l"))
    right = right.withColumn("__bin_", F.explode(F.array(*[bin_(F.col("__s")) + d for d in (-1, 0, 1)])))
    same = compatible(F.col(contig), F.col("__c"), F.col(start), F.col("__s"), F.col(end), F.col("__e"), F.col(length), F.col("__l"), most)
    return left.join(right, (F.col("__bin") == F.col("__bin_")) & same, "left_anti").drop("__bin")


def covered_ends(df: DataFrame, keys: list[str], start: str, end: str, low: str, high: str) -> DataFrame:
    """How far segments reach without a gap from `low` upward and from `high` downward: keys, prefix, suffix.

    A segment goes on from what is covered if it begins at or before its end; both are capped at high - low. low and high are
    the same in all rows of a key."""
    up = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*keys).orderBy(F.desc(end), F.desc(start)).rowsBetween(Window.unboundedPreceding, -1)
    reached = F.greatest(F.col(low), F.max(end).over(up))
    back = F.least(F.col(high), F.min(start).over(down))
    marked = df.withColumns({"__gap": F.when(F.col(start) > reached, F.col(start)), "__hole": F.when(F.col(end) < back, F.col(end))})
    bounds = marked.groupBy(*keys).agg(F.min("__gap").alias("__gap"), F.max("__hole").alias("__hole"))
    joined = df.join(bounds.withColumnsRenamed({k: f"__{k}" for k in keys}), _same(keys))
    prefix = F.max(F.when(F.col("__gap").isNull() | (F.col(start) < F.col("__gap")), F.col(end)))
    suffix = F.min(F.when(F.col("__hole").isNull() | (F.col(end) > F.col("__hole")), F.col(start)))
    grouped = joined.groupBy(*keys).agg(prefix.alias("__p"), suffix.alias("__q"), F.first(low).alias("__l"), F.first(high).alias("__h"))
    size = F.col("__h") - F.col("__l")
    zero = F.lit(0).cast("long")
    return grouped.select(*keys, F.least(F.greatest(F.coalesce(F.col("__p") - F.col("__l"), zero), zero), size).alias("prefix"), F.least(F.greatest(F.coalesce(F.col("__h") - F.col("__q"), zero), zero), size).alias("suffix"))


def _same(keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & (F.col(k) == F.col(f"__{k}"))
    return out


def best_window(df: DataFrame, keys: list[str], at: str, tie: list[str], score: str, reach: int) -> DataFrame:
    """For each key the window [first - reach, first] along `at` with the largest sum of scores, the earliest of equals:
    keys, low, high, total."""
    w = Window.partitionBy(*keys).orderBy(at).rangeBetween(-reach, 0)
    sums = df.select(*keys, F.col(at).alias("high"), F.min(at).over(w).alias("low"), F.sum(score).over(w).alias("total"))
    return keep_first(sums.distinct(), keys, [F.desc("total"), F.col("high")])


def mode(df: DataFrame, keys: list[str], value: str, lowest: bool, name: str) -> DataFrame:
    """The most frequent value for each key; of equals the lowest or the highest."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__c"))
    first = keep_first(counts, keys, [F.desc("__c"), F.col(value) if lowest else F.desc(value)])
    return first.select(*keys, F.col(value).alias(name))
