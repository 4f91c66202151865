"""Queries on clustering, consensus, matching and windows along a contig."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators.calls import best_window, covered_ends, keep_first, mode
from spanloom.operators.clustering import agglomerative_clusters, anchored_clusters, first_come, greedy_matching, merge_equal_intervals
from spanloom.operators.consensus import column_votes, reject_outliers, trim_to_third
from spanloom.operators.intervals import within_band
from spanloom.plans.registry import clips, digits_dna, digits_dna_sql, query, reads, table

_WALK = """with recursive {CLIPS}, numbered as (select *, row_number() over (partition by {K} order by pos, event_id) as k from clips),
walk as (select {K}, event_id, pos, k, pos as anchor from numbered where k = 1
  union all select n.{K1}, n.event_id, n.pos, n.k, case when n.pos - w.anchor > {D} then n.pos else w.anchor end from walk w join numbered n on {J} and n.k = w.k + 1)"""


def _walk(keys: list[str], distance: int) -> str:
    return _WALK.replace("{K}", ", ".join(keys)).replace("{K1}", ", n.".join(keys)).replace("{D}", str(distance)).replace("{J}", " and ".join(f"n.{k} = w.{k}" for k in keys))


@query("anchored_clusters", _walk(["contig"], 240) + " select event_id, contig, anchor from walk")
def anchored_clusters_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions within a distance of their cluster's first member."""
    return anchored_clusters(clips(spark, sf_dir), ["contig"], "pos", "event_id", 240).select("event_id", "contig", "anchor")


@query("anchored_cluster_extents", _walk(["contig"], 240) + " select contig, anchor, count(*) as n, max(pos) as last, min(event_id) as first_event from walk group by contig, anchor having count(*) >= 3")
def anchored_cluster_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of three or more with their extents."""
    found = anchored_clusters(clips(spark, sf_dir), ["contig"], "pos", "event_id", 240)
    return found.groupBy("contig", "anchor").agg(F.count("*").alias("n"), F.max("pos").alias("last"), F.min("event_id").alias("first_event")).where("n >= 3")


@query("region_clusters", _walk(["contig", "kind"], 4000) + " select contig, kind, anchor, count(*) as n, greatest(min(pos) - 600, 0) as low, max(pos) + 1000 as high from walk group by contig, kind, anchor")
def region_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate regions of mates: clusters by two keys, widened on both sides."""
    found = anchored_clusters(clips(spark, sf_dir), ["contig", "kind"], "pos", "event_id", 4000).groupBy("contig", "kind", "anchor")
    return found.agg(F.count("*").alias("n"), F.greatest(F.min("pos") - 600, F.lit(0)).alias("low"), (F.max("pos") + 1000).alias("high"))


@query("third_rank_trim", "with {READS} select okey, count(*) as n, list_sort(list(s))[3] as third_start, list_reverse_sort(list(e))[3] as third_end from reads group by okey having count(*) >= 3")
def third_rank_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trim_to_third(reads(spark, sf_dir), ["okey"], "s", "e")


_SEQS = f"seqs as (select o_orderkey as id, o_custkey as c, {digits_dna_sql('o_orderkey * 7')} as q, o_orderkey % 3 as o from orders)"
_VOTES = f"""{_SEQS}, chars as (select id, c, o + i as col, substr(q, cast(i + 1 as integer), 1) as base from (select *, unnest(range(length(q))) as i from seqs)),
votes as (select c, col, base, n as votes from (select *, row_number() over (partition by c, col order by n desc, base) as k from (select c, col, base, count(*) as n from chars group by all)) where k = 1)"""


def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("c"), digits_dna(F.col("o_orderkey") * 7).alias("q"), F.pmod("o_orderkey", F.lit(3)).alias("o"))


@query("consensus_vote", f"with {_VOTES} select c, col, base, votes from votes")
def consensus_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base with most votes in each column of each cluster."""
    return column_votes(_sequences(spark, sf_dir), ["c"], "q", "o")


@query(
    "consensus_reject_outliers",
    f"""with {_VOTES}, size as (select c, max(col) + 1 as size from votes group by c),
wrong as (select id, c, sum(case when chars.base <> coalesce(votes.base, 'A') then 1 else 0 end) as m from chars left join votes using (c, col) group by id, c)
select c, id, cast(m as bigint) as mismatches, m <= ceil(0.25 * size) as kept from wrong join size using (c)""",
)
def consensus_reject_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reject_outliers(_sequences(spark, sf_dir), ["c"], ["id"], "q", "o", 0.25)


@query("band_join", "with {CLIPS} select a.event_id as rc, b.event_id as lc, b.pos - a.pos as gap from clips a join clips b on a.contig = b.contig and b.pos between a.pos - 100 and a.pos + 10 where a.kind = 'click' and b.kind = 'view'")
def band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Right and left clip positions in a band."""
    c = clips(spark, sf_dir)
    right = c.where("kind = 'click'").select(F.col("event_id").alias("rc"), "contig", F.col("pos").alias("at"))
    left = c.where("kind = 'view'").select(F.col("event_id").alias("lc"), "contig", F.col("pos").alias("at2"))
    return within_band(right, left, ["contig"], "at", "at2", 100, 10).select("rc", "lc", (F.col("at2") - F.col("at")).alias("gap"))


_NEAR = "with {CLIPS}, near as (select a.contig, a.event_id as r, a.pos as rpos, b.event_id as l, b.pos as lpos, a.v + b.v as w, b.v from clips a join clips b on a.contig = b.contig and b.pos between a.pos - 300 and a.pos + 300 where a.kind = 'error' and b.kind = 'purchase')"


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = clips(spark, sf_dir)
    right = c.where("kind = 'error'").select(F.col("event_id").alias("r"), "contig", F.col("pos").alias("rpos"), F.col("v").alias("rv"))
    left = c.where("kind = 'purchase'").select(F.col("event_id").alias("l"), "contig", F.col("pos").alias("lpos"), "v")
    return within_band(right, left, ["contig"], "rpos", "lpos", 300, 300).withColumn("w", F.col("rv") + F.col("v"))


@query("top1_range_partner", _NEAR + " select r, l from (select *, row_number() over (partition by r order by v desc, lpos, l) as k from near) where k = 1")
def top1_range_partner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each right cluster the best left one in reach."""
    return first_come(_near(spark, sf_dir), ["r"], [F.desc("v"), F.col("lpos"), F.col("l")]).select("r", "l")


@query("greedy_matching")
def greedy_matching_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Right and left clusters matched one to one, heaviest pairs first. Sequential, so tests hold it against the rule worked out on all candidates."""
    return greedy_matching(_near(spark, sf_dir), ["contig"], "r", "l", "w", "rpos", 600).select("contig", "r", "l")


@query("equal_interval_merge", "with {READS} select contig, s, e, cast(sum(mapq) as bigint) as mapq, cast(sum(nm) as bigint) as nm, count(*) as members from reads group by contig, s, e")
def equal_interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_equal_intervals(reads(spark, sf_dir), ["contig"], "s", "e", ["mapq", "nm"])


@query("agglomerative_clusters")
def agglomerative_clusters_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each order merged into clusters that span 60 days at most. Sequential, so tests hold it against the rule worked out on all pairs."""
    found = agglomerative_clusters(reads(spark, sf_dir), ["okey", "contig"], "s", "e", 60)
    return found.groupBy("okey", "contig", "cluster_start", "cluster_end").agg(F.count("*").alias("n"))


@query(
    "covered_prefix_suffix",
    """with recursive {READS}, bounds as (select okey, min(s) as lo, max(e) as hi from reads group by okey),
up as (select okey, s, e, row_number() over (partition by okey order by s, e) as k from reads), down as (select okey, s, e, row_number() over (partition by okey order by e desc, s desc) as k from reads),
fwd as (select okey, k, e as reach, true as go from up where k = 1 union all select u.okey, u.k, case when f.go and u.s <= f.reach then greatest(f.reach, u.e) else f.reach end, f.go and u.s <= f.reach from fwd f join up u on u.okey = f.okey and u.k = f.k + 1),
bwd as (select okey, k, s as reach, true as go from down where k = 1 union all select d.okey, d.k, case when b.go and d.e >= b.reach then least(b.reach, d.s) else b.reach end, b.go and d.e >= b.reach from bwd b join down d on d.okey = b.okey and d.k = b.k + 1)
select okey, max(f.m) - any_value(lo) as prefix, any_value(hi) - min(b.m) as suffix from bounds join (select okey, max(reach) as m from fwd group by okey) f using (okey) join (select okey, min(reach) as m from bwd group by okey) b using (okey) group by okey""",
)
def covered_prefix_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far segments cover an order's span from each end without a gap."""
    r = reads(spark, sf_dir).select("okey", "s", "e")
    bounds = r.groupBy("okey").agg(F.min("s").alias("lo"), F.max("e").alias("hi"))
    return covered_ends(r.join(bounds, "okey"), ["okey"], "s", "e", "lo", "hi")


@query(
    "sliding_max_sum_window",
    """with {CLIPS}, w as (select distinct contig, pos as high, min(pos) over f as low, cast(sum(v) over f as bigint) as total from clips window f as (partition by contig order by pos range between 1000 preceding and current row))
select contig, high, low, total from (select *, row_number() over (partition by contig order by total desc, high) as k from w) where k = 1""",
)
def sliding_max_sum_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stretch of each contig with the largest sum of scores."""
    return best_window(clips(spark, sf_dir), ["contig"], "pos", ["event_id"], "v", 1000)


@query(
    "mode_start_end",
    """with {READS}, a as (select okey, s, row_number() over (partition by okey order by count(*) desc, s) as k from reads group by okey, s), b as (select okey, e, row_number() over (partition by okey order by count(*) desc, e desc) as k from reads group by okey, e)
select okey, s as mode_start, e as mode_end from a join b using (okey) where a.k = 1 and b.k = 1""",
)
def mode_start_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent start (lowest of equals) and end (highest of equals)."""
    r = reads(spark, sf_dir)
    return mode(r, ["okey"], "s", True, "mode_start").join(mode(r, ["okey"], "e", False, "mode_end"), "okey")


@query("top3_candidates", "with {READS} select okey, rid, place from (select okey, rid, row_number() over (partition by okey order by mapq desc, e - s, rid, s) as place from reads) where place <= 3")
def top3_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best regions: highest score, then shortest."""
    from spanloom.operators.sampling import limit_per_window

    kept = limit_per_window(reads(spark, sf_dir).withColumn("len", F.col("e") - F.col("s")), ["okey"], [F.desc("mapq"), "len", "rid", "s"], 3)
    return kept.select("okey", "rid", F.col("place").cast("long").alias("place"))


@query("dedup_keep_first", "with {READS} select contig, s, e, rid, mapq from (select *, row_number() over (partition by contig, s, e order by mapq, nm desc, rid) as k from reads) where k = 1")
def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One call for each place, the first in order of support."""
    return keep_first(reads(spark, sf_dir), ["contig", "s", "e"], [F.col("mapq"), F.desc("nm"), F.col("rid")]).select("contig", "s", "e", "rid", "mapq")
