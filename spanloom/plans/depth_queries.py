"""Queries on depth, sampling and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators.coverage import median_covered, quality_percentile, spanning_pairs
from spanloom.operators.running import depth_at, order_statistics
from spanloom.operators.sampling import average_depth, cap_windows, crossing_counts, default_lookup, head_max, insert_size_model, limit_per_window, offsets_to_regions, pairs_by_size
from spanloom.plans.registry import pairs, points, query, reads, table

_DEPTHS = """{READS}, {POINTS},
starts as (select contig, s as at, count(*) as d from reads group by all union all select contig, e as at, -count(*) as d from reads group by all),
places as (select distinct contig, p from points),
depths as (select p.contig, p.p, coalesce(sum(s.d), 0) as depth from places p left join starts s on s.contig = p.contig and s.at <= p.p group by all),
sampled as (select points.*, cast(depths.depth as bigint) as depth from points join depths using (contig, p))"""


def _sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return depth_at(points(spark, sf_dir), reads(spark, sf_dir), ["contig"], "p", "s", "e")


@query("sampled_depth", "with {READS}, {POINTS} select pid, points.contig, p, count(okey) as depth from points left join reads on points.contig = reads.contig and s <= p and p < e group by all")
def sampled_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of reads that cover each sampled position."""
    return _sampled(spark, sf_dir)


def _ranks() -> dict:
    return {"min_depth": F.expr("n div 100"), "median_depth": F.expr("n div 2"), "max_depth": F.expr("n - n div 100")}


_PICK = "count(*) as n, list_sort(list(depth))[count(*) // 100 + 1] as min_depth, list_sort(list(depth))[count(*) // 2 + 1] as median_depth, list_sort(list(depth))[least(count(*) - 1, count(*) - count(*) // 100) + 1] as max_depth"


@query("depth_order_stats", f"with {_DEPTHS} select {_PICK} from sampled where depth > 0")
def depth_order_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_statistics(_sampled(spark, sf_dir).where("depth > 0"), [], "depth", _ranks())


def _by_contig(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_statistics(_sampled(spark, sf_dir).where("depth > 0"), ["contig"], "depth", _ranks()).where("n >= 1000")


@query("depth_order_stats_by_contig", f"with {_DEPTHS} select contig, {_PICK} from sampled where depth > 0 group by contig having count(*) >= 1000")
def depth_order_stats_by_contig(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_contig(spark, sf_dir)


@query(
    "stats_with_fallback",
    f"""with {_DEPTHS},
stats as (select contig, median_depth as value from (select contig, {_PICK} from sampled where depth > 0 group by contig having count(*) >= 1000)
  union all select '.' as contig, median_depth from (select {_PICK} from sampled where depth > 0)),
wanted as (select distinct contig from reads union select substr(n_name, 1, 1) || n_regionkey from nation)
select w.contig, coalesce(s.value, (select value from stats where contig = '.')) as value from wanted w left join stats s on s.contig = w.contig""",
)
def stats_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median depth of each contig, or that of all where a contig has too few samples."""
    sampled = _sampled(spark, sf_dir).where("depth > 0")
    own = order_statistics(sampled, ["contig"], "depth", _ranks()).where("n >= 1000").select("contig", F.col("median_depth").alias("value"))
    whole = order_statistics(sampled, [], "depth", _ranks()).select(F.lit(".").alias("contig"), F.col("median_depth").alias("value"))
    named = table(spark, sf_dir, "nation").select(F.concat(F.substring("n_name", 1, 1), F.col("n_regionkey").cast("string")).alias("contig"))
    wanted = reads(spark, sf_dir).select("contig").unionByName(named).distinct()
    return default_lookup(own.unionByName(whole), wanted, "contig")


@query("pair_crossing_counts", "with {READS}, {POINTS}, {PAIRS} select pid, count(*) as crossing, cast(sum(hi - 5 - p) as bigint) as distance from points join pairs on points.contig = pairs.contig and lo + 5 <= p and p < hi - 5 group by pid")
def pair_crossing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs whose inner part crosses a position; sums by running totals, as no pair needs to be seen."""
    inner = pairs(spark, sf_dir).select("contig", (F.col("lo") + 5).alias("a"), (F.col("hi") - 5).alias("b")).where("b > a")
    counted = depth_at(points(spark, sf_dir), inner, ["contig"], "p", "a", "b", "crossing").where("crossing > 0")
    from spanloom.operators.running import running_total

    ends = inner.select("contig", F.col("a").alias("at"), F.col("b").alias("w")).unionByName(inner.select("contig", F.col("b").alias("at"), (-F.col("b")).alias("w")))
    places = counted.select("contig", F.col("p").alias("at")).distinct().withColumn("asked", F.lit(True))
    steps = ends.groupBy("contig", "at").agg(F.sum("w").alias("w")).join(places, ["contig", "at"], "full").fillna(0, ["w"])
    sums = running_total(steps, ["contig"], "at", "w", "ends").where("asked").select("contig", F.col("at").alias("p"), "ends")
    return counted.join(sums, ["contig", "p"]).select("pid", "crossing", (F.col("ends") - F.col("crossing") * F.col("p")).alias("distance"))


@query(
    "min_pairs_by_size",
    """with {READS}, {POINTS}, {PAIRS},
crossing as (select pid, hi - 5 - p as dist from points join pairs on points.contig = pairs.contig and lo + 5 <= p and p < hi - 5 where hi - 5 - p <= 60),
upto as (select pid, size, count(dist) filter (dist <= size) as c from (select distinct pid from crossing) join (select unnest(range(0, 61)) as size) on true join crossing using (pid) group by pid, size)
select size, list_sort(list(c))[count(*) // 200 + 1] as min_pairs from upto group by size""",
)
def min_pairs_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each size the number of crossing pairs up to it that all but half a percent of positions reach."""
    inner = pairs(spark, sf_dir).select("contig", (F.col("lo") + 5).alias("a"), (F.col("hi") - 5).alias("b"))
    places = points(spark, sf_dir)
    crossing = crossing_counts(places, inner, ["contig"], "p", "a", "b", 60, 64)
    return pairs_by_size(crossing, ["contig", "p"], "size", "pairs", places.groupBy("contig", "p").agg(F.count("*").alias("weight")), 60)


@query(
    "quality_percentile",
    """with bins as (select cast(floor(l_extendedprice / 2500 + 0.5) as bigint) as bin, count(*) as c from lineitem group by 1),
upto as (select bin, sum(c) over (order by bin) as t, (select count(*) from lineitem) as n from bins)
select case when n < 100 then 0 else min(bin) end as bin from upto where t >= n // 100 group by n""",
)
def quality_percentile_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_percentile(table(spark, sf_dir, "lineitem").select((F.col("l_extendedprice") / 2500).alias("q")), "q")


@query(
    "insert_size_model",
    """with x as (select cast(floor(o_totalprice / 1000) as double) as x from orders), m as (select avg(x) as m, stddev_pop(x) as d from x),
t as (select x from x, m where abs(x - m) < 5 * d), c as (select avg(x) as c from t),
f as (select cast(trunc(max(c)) as bigint) as avg_is, cast(trunc(coalesce(sqrt(avg(case when x < c then (c - x) * (c - x) end)), 0)) as bigint) as low, cast(trunc(coalesce(sqrt(avg(case when x > c then (c - x) * (c - x) end)), 0)) as bigint) as high from t, c)
select avg_is, low, high, avg_is - 3 * low as min_is, avg_is + cast(floor(3.5 * high) as bigint) as max_is from f""",
)
def insert_size_model_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insert_size_model(table(spark, sf_dir, "orders").select(F.floor(F.col("o_totalprice") / 1000).alias("x")), "x")


@query("per_window_limit_sample", "with {READS} select contig, w, rid, place from (select contig, s // 100 as w, rid, row_number() over (partition by contig, s // 100 order by s, rid) as place from reads) where place <= 101")
def per_window_limit_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 101 reads of each window of each contig, in coordinate order."""
    kept = limit_per_window(reads(spark, sf_dir).withColumn("w", F.expr("s div 100")), ["contig", "w"], ["s", "rid"], 101)
    return kept.select("contig", "w", "rid", F.col("place").cast("long").alias("place"))


@query(
    "anchor_coverage_median",
    """with {READS}, targets as (select c_custkey as id, substr('ANR', cast(c_custkey % 3 + 1 as integer), 1) as contig, c_custkey % 2400 as lo, c_custkey % 2400 + 4 + c_nationkey as hi from customer),
cells as (select id, q, count(*) as d from (select id, contig, unnest(range(lo, hi)) as q from targets) t join reads r on t.contig = r.contig and r.s <= t.q and t.q < r.e group by id, q),
picked as (select id, count(*) as covered, list_reverse_sort(list(d))[count(*) // 2 + 1] as median, count(*) as n from cells group by id),
whole as (select t.id, t.hi - t.lo as n from targets t)
select w.id, coalesce(p.covered, 0) as covered, cast(coalesce(case when p.covered // 2 < p.covered then p.median end, 0) as bigint) as median from whole w left join picked p using (id)""",
)
def anchor_coverage_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median of non-zero depths over each anchor."""
    customer = table(spark, sf_dir, "customer")
    contig = F.element_at(F.array(*map(F.lit, "ANR")), (F.pmod("c_custkey", F.lit(3)) + 1).cast("int"))
    low = F.pmod("c_custkey", F.lit(2400)).cast("long")
    targets = customer.select(F.col("c_custkey").alias("id"), contig.alias("contig"), low.alias("lo"), (low + 4 + F.col("c_nationkey")).alias("hi"))
    return median_covered(targets, reads(spark, sf_dir), ["contig"], ["id"], "lo", "hi", "s", "e", 32)


@query("spanning_pairs", "with {READS}, {POINTS}, {PAIRS} select pid, count(okey) as spanning from points left join pairs on points.contig = pairs.contig and p between lo + 2 and hi - 2 group by pid")
def spanning_pairs_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = pairs(spark, sf_dir).select("contig", (F.col("lo") + 2).alias("a"), (F.col("hi") - 2).alias("b"))
    return spanning_pairs(points(spark, sf_dir), inner, ["contig"], ["pid"], "p", "a", "b", 64).select("pid", "spanning")


@query(
    "random_offset_to_region",
    """with laid as (select n_nationkey as region, sum(length(n_name) * 100 + n_regionkey) over (order by n_nationkey) as e, length(n_name) * 100 + n_regionkey as n from nation),
offsets as (select o_orderkey as pid, (o_orderkey * 7919) % (select max(e) from laid) as off from orders)
select pid, region, cast(off - (e - n) as bigint) as place from offsets join laid on e - n <= off and off < e""",
)
def random_offset_to_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets into regions laid end to end."""
    regions = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("region"), (F.length("n_name") * 100 + F.col("n_regionkey")).alias("n"))
    total = regions.agg(F.sum("n").alias("total"))
    offsets = table(spark, sf_dir, "orders").join(F.broadcast(total)).select(F.col("o_orderkey").alias("pid"), F.pmod(F.col("o_orderkey") * 7919, F.col("total")).alias("at"))  # one row
    return offsets_to_regions(offsets, regions, "at", "region", "n", "region", 256).select("pid", "region", "place")


@query("partial_final_sum", "with {READS} select contig, strand, count(*) as n, cast(sum(qty) as bigint) as total, min(s) as first, max(e) as last from reads group by contig, strand")
def partial_final_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics that tasks add up before they are merged."""
    return reads(spark, sf_dir).groupBy("contig", "strand").agg(F.count("*").alias("n"), F.sum("qty").alias("total"), F.min("s").alias("first"), F.max("e").alias("last"))


@query("head_read_length", "select max(length(p_name)) as most from (select * from part order by p_partkey limit 1001)")
def head_read_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest sequence among the first 1,001 records."""
    return head_max(table(spark, sf_dir, "part"), ["p_partkey"], F.length("p_name").cast("long"))


@query("average_sampled_depth", "with {READS}, {POINTS}, d as (select pid, count(okey) as depth from points left join reads on points.contig = reads.contig and s < p and p < e group by pid) select sum(depth) / cast(count(*) as double) as average from d")
def average_sampled_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads before and over each sampled position, on average."""
    return average_depth(points(spark, sf_dir), reads(spark, sf_dir), ["contig"], "p", "s", "e")


@query(
    "capped_window_sample",
    """with {READS}, kept as (select contig, w, rid, s, place from (select contig, s // 10 as w, rid, s, row_number() over (partition by contig, s // 10 order by s, rid) as place from reads) where place <= 101),
sizes as (select contig, w, sum(count(*)) over (order by contig, w rows between unbounded preceding and 1 preceding) as before from kept group by contig, w)
select contig, w, rid, s from kept join sizes using (contig, w) where coalesce(before, 0) < 10000""",
)
def capped_window_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 101 reads of each window, from as many windows as it takes for 10,000 in all."""
    kept = limit_per_window(reads(spark, sf_dir).withColumn("w", F.expr("s div 10")), ["contig", "w"], ["s", "rid"], 101)
    return cap_windows(kept, ["contig", "w"], 10_000).select("contig", "w", "rid", "s")
