"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Every document of a source is wanted the same number of times, its source's target over its source's size. The whole part of
that number is taken for sure; the rest is a probability of one more copy. Probabilities are rounded in pairs: words of
expectation move from one document to the other, in a random direction whose odds keep both expectations, until one of the two
is wholly in or wholly out. The sum over both never changes, so a source's words end within one document of its target.

Pairing goes up a tree: documents of a source are dealt into blocks, a block is folded down to at most one fractional document,
and these residuals are dealt into blocks again, until one block is left for each source. No block grows with the data. In that
last block the largest document is paired with all smaller ones together, which share what it gives or takes, then the next
largest; so what no one can take over in the end is about the smallest document of the block, not the largest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import Scratch

#: Weights of the sources in their order, repeating; copies of a document at most.
CYCLE, MOST = (1, 2, 3), 3
#: Documents of a block, on average.
FAN = 128
SEED = 20_177
WORD = r"[^\x20\x09-\x0D]+"
#: Tables of up to so many sources are sent to every task; larger ones are joined by shuffling.
FEW_SOURCES = 50_000
#: Probabilities closer than this to a whole number are taken as whole.
_CLOSE = 1e-12
#: Repeated rows that one array makes at a time.
_RUN = 4096


def mix(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text", source: str = "source", cycle: Sequence[int] = CYCLE, most: int = MOST, fan: int = FAN, seed: int = SEED) -> DataFrame:
    """Adds to the kept columns: size (words of the text; null has none), source_size, target (words wanted of its source), copies
    and taken (copies times size). One row for each row of docs.

    Sources in order of code points, null last as a source of its own, weigh `cycle`, repeating. Targets share the size of all
    documents by weight, and stop at `most` times their source's size; what is beyond is shared among the others by weight.
    Documents without words are taken in their whole number of copies, of no words. Rows that agree in the kept columns, source
    and size stand for one another: which of them has a copy more says nothing. Decisions follow from a hash of these columns,
    so runs agree. An empty table gives none. Other columns of docs may have any names.
    """
    tables = Scratch(docs.sparkSession, "mix")
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.struct(*keep).alias("k"), F.col(source).alias("s"), size.alias("size"))
    groups = tables.table(rows.groupBy("k", "s", "size").agg(F.count("*").alias("m")), "groups")
    plan = _targets(groups, tables, cycle, most)
    most_rows = plan.agg(F.max("rows")).first()[0] or 0
    if plan.count() <= FEW_SOURCES:
        plan = F.broadcast(plan)
    joined = groups.join(plan.withColumnRenamed("s", "ps"), F.col("s").eqNullSafe(F.col("ps"))).drop("ps")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    wanted = joined.withColumn("base", F.floor(ratio + _CLOSE)).withColumn("part", F.greatest(ratio - F.col("base"), F.lit(0.0)))
    wanted = wanted.withColumn("sure", F.floor(F.col("m") * F.col("part") + _CLOSE))
    wanted = wanted.withColumn("y", F.greatest(F.col("m") * F.col("part") - F.col("sure"), F.lit(0.0)) * F.col("size"))
    open_ = F.col("y") > F.col("size") * _CLOSE
    row = F.struct("k", "size", "source_size", "target", "base", "sure", "m")
    decided = [wanted.where(~open_).select(row.alias("row"), F.lit(0).alias("up"))]
    held = wanted.where(open_).select("s", F.col("rows").alias("blocks"), F.struct(F.xxhash64("k", "s", "size", F.lit(seed)).alias("h"), "y", "size", row.alias("row")).alias("unit"))
    level = 0
    while level == 0 or most_rows > 1:
        most_rows = -(-most_rows // fan)
        folded = tables.table(_fold(held, fan, seed + level), f"level{level}")
        decided.append(folded.select(F.inline("done")))
        held = folded.where(F.col("held").isNotNull()).select("s", "blocks", F.col("held").alias("unit"))
        level += 1
    out = decided[0]
    for more in decided[1:]:
        out = out.unionByName(more)
    out = out.select("row.*", (F.col("row.sure") + F.col("up")).alias("extra"))
    out = out.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / _RUN))))
    out = out.withColumn("i", F.explode(F.sequence(F.col("run") * _RUN + 1, F.least(F.col("m"), (F.col("run") + 1) * _RUN))))
    copies = F.col("base") + (F.col("i") <= F.col("extra")).cast("long")
    return out.select("k", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")).select("k.*", "size", "source_size", "target", "copies", "taken")


def _targets(groups: DataFrame, tables: Scratch, cycle: Sequence[int], most: int) -> DataFrame:
    """For each source: s, source_size, rows (of groups) and target."""
    totals = groups.groupBy("s").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count("*").alias("rows"))
    # Ranks without one task for all sources: rows are numbered within sorted ranges, and ranges follow each other.
    parts = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = totals.repartitionByRange(parts, F.col("s").asc_nulls_last()).sortWithinPartitions(F.col("s").asc_nulls_last())
    numbered = tables.table(sorted_.withColumn("at", F.monotonically_increasing_id()), "sources")
    ranges = sorted((r["part"], r["n"]) for r in numbered.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n")).collect())
    begins, before = [F.lit(-1), F.lit(0)], 0
    for part, n in ranges:  # as many as there are partitions
        begins += [F.lit(part), F.lit(before)]
        before += n
    rank = F.create_map(*begins)[F.shiftright("at", 33).cast("int")] + F.col("at").bitwiseAND((1 << 33) - 1)
    weight = F.element_at(F.array(*map(F.lit, cycle)), (F.pmod(rank, F.lit(len(cycle))) + 1).cast("int"))
    weighed = tables.table(numbered.select("s", "source_size", "rows", weight.cast("long").alias("w")), "weights")
    # The common level of targets over weights: sources whose bound lies below it give what is beyond to the others.
    words = weighed.agg(F.sum("source_size")).first()[0] or 0
    level, bound = 0.0, F.col("source_size") * most
    while words:
        below = bound.cast("double") <= F.col("w") * F.lit(level)
        capped, w = weighed.agg(F.sum(F.when(below, bound).otherwise(0)), F.sum(F.when(below, 0).otherwise(F.col("w")))).first()
        raised = (words - capped) / w if w else level
        if raised <= level:
            break
        level = raised
    return tables.table(weighed.select("s", "source_size", "rows", F.least(bound.cast("double"), F.col("w") * F.lit(level)).alias("target")), "targets")


def _uniform(*hashes: Column) -> Column:
    """From 0 to below 1."""
    return F.shiftrightunsigned(F.xxhash64(*hashes), 11) / float(1 << 53)


def _let(value: Column, then) -> Column:
    """then(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _fold(held: DataFrame, fan: int, seed: int) -> DataFrame:
    """held: s, blocks (of the level below) and unit: h, y (expected words), size, row. For each block: s, blocks (of this level),
    held (the unit that is left in between, null if none) and done (rows that came out whole, and whether in)."""
    unit = held.schema["unit"].dataType
    now = F.ceil(F.col("blocks") / fan)
    dealt = held.select("s", now.alias("blocks"), F.pmod(F.xxhash64("unit.h", F.lit(seed)), now).alias("block"), "unit")
    lists = dealt.groupBy("s", "blocks", "block").agg(F.sort_array(F.collect_list("unit")).alias("units"))
    nobody = F.lit(None).cast(unit)
    start = F.struct(nobody.alias("held"), F.array().cast(f"array<struct<row:{unit['row'].dataType.simpleString()},up:int>>").alias("done"))

    def out(x: Column, up: Column) -> Column:
        return F.array(F.struct(x["row"].alias("row"), up.cast("int").alias("up")))

    def moved(x: Column, y: Column) -> Column:
        return F.struct(x["h"].alias("h"), y.alias("y"), x["size"].alias("size"), x["row"].alias("row"))

    def pair(acc: Column, x: Column) -> Column:
        a, done = acc["held"], acc["done"]
        gain = F.least(a["size"] - a["y"], x["y"])  # what the first can take from the second
        loss = F.least(a["y"], x["size"] - x["y"])
        odds = F.struct(gain.alias("gain"), loss.alias("loss"), (_uniform(a["h"], x["h"], F.lit(seed)) * (gain + loss) < loss).alias("up"))

        def settle(t: Column) -> Column:
            first = F.when(t["up"], a["size"] - a["y"] <= x["y"]).otherwise(a["y"] <= x["size"] - x["y"])  # the first comes out whole
            second = F.when(t["up"], x["y"] <= a["size"] - a["y"]).otherwise(x["size"] - x["y"] <= a["y"])
            step = F.when(t["up"], t["gain"]).otherwise(-t["loss"])
            rest = F.when(first & second, nobody).when(first, moved(x, x["y"] - step)).otherwise(moved(a, a["y"] + step))
            whole = F.when(first & second, F.concat(out(a, t["up"]), out(x, ~t["up"]))).when(first, out(a, t["up"])).otherwise(out(x, ~t["up"]))
            return F.struct(rest.alias("held"), F.concat(done, whole).alias("done"))

        return F.when(a.isNull(), F.struct(x.alias("held"), done.alias("done"))).otherwise(_let(odds, settle))

    def spread(acc: Column, i: Column) -> Column:
        """Settles the first of acc's units, from the largest on, against all others."""
        a = F.element_at(acc["units"], 1)
        others = F.slice(acc["units"], 2, F.size(acc["units"]))

        def settle(t: Column) -> Column:
            up, most = t["up"], F.greatest(t["reach"], F.lit(1.0))
            rest = F.transform(others, lambda x: moved(x, F.greatest(F.lit(0.0), F.least(x["size"].cast("double"), x["y"] + F.when(up, -t["gain"]).otherwise(t["loss"]) * _share(x, t) / most))))
            return F.struct(rest.alias("units"), F.concat(acc["done"], out(a, up)).alias("done"))

        gain, loss = a["size"] - a["y"], a["y"]
        step = F.struct(gain.alias("gain"), loss.alias("loss"))
        reach = _let(step, lambda t: F.aggregate(others, F.lit(0.0), lambda n, x: n + _share(x, t)))
        up = _uniform(a["h"], F.lit(seed)) * a["size"] < a["y"]
        return _let(F.struct(gain.alias("gain"), loss.alias("loss"), reach.alias("reach"), up.alias("up")), settle)

    by_size = F.transform(F.reverse(F.sort_array(F.transform("units", lambda x: F.struct(x["size"].alias("size"), x["h"].alias("h"), x.alias("x"))))), lambda t: t["x"])
    first = F.struct(by_size.alias("units"), start["done"].alias("done"))
    top = F.aggregate(F.sequence(F.lit(1), F.size("units")), first, spread)
    end = F.when(F.col("blocks") == 1, F.struct(nobody.alias("held"), top["done"].alias("done"))).otherwise(F.aggregate("units", start, pair))
    return lists.withColumn("end", end).select("s", "blocks", "end.held", "end.done")


def _share(x: Column, t: Column) -> Column:
    """Which part of another's step, whose odds are t, x can take over in either direction: its words on the way up, its room on
    the way down."""
    return F.least(F.when(t["gain"] > 0, x["y"] / t["gain"]).otherwise(1.0), F.when(t["loss"] > 0, (x["size"] - x["y"]) / t["loss"]).otherwise(1.0))
