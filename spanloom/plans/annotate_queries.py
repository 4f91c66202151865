"""Queries on evidence around calls and on clusters' joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import annotate
from spanloom.plans.registry import alignments, points, query, table

_OPS = r"list_zip(regexp_extract_all({c}, '(\d+)([MIDNSHP=X])', 1), regexp_extract_all({c}, '(\d+)([MIDNSHP=X])', 2))"


def _total(cigar: str, kinds: str) -> str:
    listed = ", ".join(f"'{k}'" for k in kinds)
    return f"cast(coalesce(list_sum(list_transform(list_filter({_OPS.replace('{c}', cigar)}, lambda x: x[2] in ({listed})), lambda x: cast(x[1] as bigint))), 0) as bigint)"


_CLIP = r"(regexp_matches(cigar, '^\d+S') or regexp_matches(cigar, 'S$'))"
_MATE_CLIP = r"coalesce(regexp_matches(mate_cigar, '^\d+S') and regexp_matches(mate_cigar, 'S$'), false)"


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as calls with anchors: id, contig, left_anchor, right_anchor."""
    at, contig = F.pmod("c_custkey", F.lit(2400)), F.element_at(F.array(*map(F.lit, "ANR")), (F.pmod("c_custkey", F.lit(3)) + 1).cast("int"))
    span = lambda a, b: F.concat((at + a).cast("string"), F.lit("-"), (at + b).cast("string"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), contig.alias("contig"), span(0, 8).alias("left_anchor"), span(30, 41).alias("right_anchor"))


_ANCHORS = f"""ends as (select contig, s, s + {_total('cigar', 'MDN=X')} as e from alignments),
calls as (select c_custkey as id, substr('ANR', cast(c_custkey % 3 + 1 as integer), 1) as contig, c_custkey % 2400 as lo from customer),
cells as (select id, contig, 'l' as side, unnest(range(lo, lo + 8)) as q from calls union all select id, contig, 'r' as side, unnest(range(lo + 30, lo + 41)) as q from calls),
steps as (select contig, s as w, count(*) as d from ends group by all union all select contig, e as w, -count(*) as d from ends group by all),
places as (select distinct contig, q from cells),
depths as (select p.contig, p.q, cast(sum(x.d) as bigint) as d from places p join steps x on x.contig = p.contig and x.w <= p.q group by all),
medians as (select id, side, list_reverse_sort(list(d))[count(*) // 2 + 1] as m from cells join depths using (contig, q) where d > 0 group by id, side)"""


@query("flank_depths", f"with {{READS}}, {{ALIGNMENTS}}, {_ANCHORS} select id, coalesce((select m from medians x where x.id = calls.id and side = 'l'), 0) as left_depth, coalesce((select m from medians x where x.id = calls.id and side = 'r'), 0) as right_depth from calls")
def flank_depths_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median depth of both anchors of each call."""
    reads = alignments(spark, sf_dir).select("contig", F.col("s").alias("pos"), "cigar")
    return annotate.flank_depths(_calls(spark, sf_dir), reads, 64).select("id", "left_depth", "right_depth")


_GOOD = f"good as (select *, cast(okey as varchar) as qname, case when ln % 2 = 1 then 50 else -50 end as size, s + 60 as mate_pos from alignments where flag & 4 = 0 and flag & 2306 = 2 and not {_CLIP} and not {_MATE_CLIP})"
_MATE_END = f"case when mate_cigar is null then mate_pos else mate_pos + {_total('mate_cigar', 'MDNHP=X')} - 1 end"


@query(
    "spanning_counts",
    f"""with {{READS}}, {{ALIGNMENTS}}, {{POINTS}}, {_GOOD},
pairs as (select contig, s + 5 as a, {_MATE_END} - 5 as b from good g where size > 0 and exists (select 1 from good h where h.contig = g.contig and h.qname = g.qname and h.size < 0)),
l as (select pid, count(*) as n from points join pairs on points.contig = pairs.contig and p between a and b group by pid), r as (select pid, count(*) as n from points join pairs on points.contig = pairs.contig and p + 40 between a and b group by pid)
select pid, coalesce(l.n, 0) as left_spanning, coalesce(r.n, 0) as right_spanning from points left join l using (pid) left join r using (pid)""",
)
def spanning_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that span both ends of each call."""
    a = alignments(spark, sf_dir)
    reads = a.select("contig", F.col("okey").cast("string").alias("qname"), "flag", "cigar", F.col("s").alias("pos"), (F.col("s") + 60).alias("mate_pos"), F.col("mate_cigar").alias("mc"), F.when(F.col("ln") % 2 == 1, 50).otherwise(-50).alias("isize"), F.lit(None).cast("string").alias("qual"))
    calls = points(spark, sf_dir).select("pid", "contig", F.col("p").alias("start"), (F.col("p") + 40).alias("end"))
    return annotate.spanning_counts(calls, reads, 10).select("pid", "left_spanning", "right_spanning")


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as clusters: id, contig, side, start, end, members."""
    start, contig = F.pmod("c_custkey", F.lit(2400)), F.element_at(F.array(*map(F.lit, "ANR")), (F.pmod("c_custkey", F.lit(3)) + 1).cast("int"))
    side = F.when(F.col("c_custkey") % 2 == 0, "R").otherwise("L")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), contig.alias("contig"), side.alias("side"), start.alias("start"), (start + 20).alias("end"), F.col("c_nationkey").cast("long").alias("members"))


@query(
    "semi_mapped_join",
    """with {POINTS}, c as (select c_custkey as id, substr('ANR', cast(c_custkey % 3 + 1 as integer), 1) as contig, case when c_custkey % 2 = 0 then c_custkey % 2400 + 20 - 60 else c_custkey % 2400 end as low, c_nationkey as members from customer),
held as (select pid, points.contig, id, row_number() over (partition by points.contig, pid order by members desc, id) as k from points join c on c.contig = points.contig and low <= p and p + 3 <= low + 60)
select id as cluster, contig, pid as qname from held where k = 1""",
)
def semi_mapped_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs within reach of a cluster, each with the largest one."""
    pairs = points(spark, sf_dir).select("contig", F.col("pid").alias("qname"), F.col("p").alias("mate_start"), (F.col("p") + 3).alias("mate_end"))
    return annotate.semi_mapped(_clusters(spark, sf_dir), pairs, 60, 64)


@query("matched_clusters")
def matched_clusters_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Right and left clusters matched one to one by the product of their members. Sequential, so tests hold the matching against the
    rule worked out on all candidates."""
    c = _clusters(spark, sf_dir)
    return annotate.matched_clusters(c.where("side = 'R'"), c.where("side = 'L'"), 60).select("contig", "r", "l")
