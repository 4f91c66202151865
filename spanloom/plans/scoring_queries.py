"""Queries on regions scored by placing reads: parts' names as bases, laid end to end, and pieces of them as mates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions.align import Scoring
from spanloom.functions.sequences import reverse_complement
from spanloom.operators.scoring import best_regions, score_regions
from spanloom.plans.registry import dna, dna_sql, query, table
from spanloom.shared import Scratch

#: No mismatch and no gap pays, so the best alignment is the longest common piece, which SQL can find.
_EXACT = Scoring(1, 100, 100, 100)
_LEAST, _CLIP, _LONGEST, _CHUNK = 15, 3, 120, 256


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """members, regions, reference. The parts of a block of 2,000 and of one size make up a contig; parts of two sizes a cluster, whose
    mates are pieces of two parts that follow each other; both sizes' contigs are its regions."""
    along = Window.partitionBy("block", "p_size").orderBy("p_partkey")
    part = table(spark, sf_dir, "part").select("p_partkey", F.expr("p_partkey div 2000").alias("block"), F.col("p_size").cast("long").alias("p_size"), dna(F.col("p_name")).alias("q"))
    part = part.withColumns({"cluster": F.col("block") * 25 + F.pmod("p_size", F.lit(25)), "contig": F.col("block") * 1000 + F.col("p_size"), "piece": F.concat("q", F.coalesce(F.lead("q").over(along), F.lit("")))})
    text = part.groupBy("contig", "cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "q"))), lambda x: x["q"]), "").alias("t"))
    reference = text.select("contig", F.posexplode(F.regexp_extract_all("t", F.lit(f".{{1,{_CHUNK}}}"), F.lit(0))).alias("chunk_id", "chunk")).withColumn("chunk_id", F.col("chunk_id").cast("long"))
    regions = text.select("cluster", F.col("contig").alias("region"), "contig", F.lit(0).cast("long").alias("low"), F.length("t").cast("long").alias("high"))
    side = F.when(F.col("p_partkey") % 2 == 0, "R").otherwise("L")
    members = part.withColumn("side", side).withColumn("clip", F.col("p_partkey") == F.min("p_partkey").over(Window.partitionBy("cluster", "side")))
    seq = F.when(~F.col("clip") & (F.col("side") == "R"), reverse_complement(F.col("piece"))).otherwise(F.col("piece"))
    return members.select("cluster", "side", F.col("p_partkey").alias("member"), "clip", seq.alias("seq")), regions, reference


def _placed(name: str, queries: str, stretches: str) -> str:
    return f"""{name} as materialized (
  select cluster, region, rc, side, member, clip, low + best.e - best.k as start, low + best.e - 1 as "end", best.k as score, best.k >= {_LEAST} as accepted, best.i - 1 >= {_CLIP} as lclip, n - (best.i + best.k - 1) >= {_CLIP} as rclip
  from (
    select cluster, region, rc, side, member, clip, low, n, min(struct_pack(m := -k, e := p + k - 1, i := i, k := k)) as best from (
      select cluster, region, rc, side, member, clip, low, length(q) as n, i, k, instr(substr(t, low + 1, high - low), substr(q, i, k)) as p
      from {queries} q join (select * from {stretches} where high > low) s using (cluster, region, rc, side) join texts on contig = region, lateral (select unnest(range(1, length(q) + 1)) as i) a, lateral (select unnest(range(1, length(q) - i + 2)) as k) b
    ) where p > 0 group by all)
)"""


_SCORES = f"""
with part0 as (select p_partkey, p_partkey // 2000 as block, cast(p_size as bigint) as p_size, {dna_sql('p_name')} as q from part),
part1 as (select *, block * 25 + p_size % 25 as cluster, block * 1000 + p_size as contig, q || coalesce(lead(q) over (partition by block, p_size order by p_partkey), '') as piece, case when p_partkey % 2 = 0 then 'R' else 'L' end as side from part0),
texts as materialized (select contig, any_value(cluster) as cluster, string_agg(q, '' order by p_partkey) as t from part1 group by contig),
members as (select cluster, side, p_partkey as member, p_partkey = min(p_partkey) over (partition by cluster, side) as clip, piece from part1),
turns as (select unnest([false, true]) as rc),
asked as materialized (
  select m.cluster, t.contig as region, rc, side, member, clip, case when rc then translate(reverse(piece), 'ACGT', 'TGCA') else piece end as q
  from (select cluster, side, member, clip, piece from members) m join texts t using (cluster), turns
),
cases as (select cluster, contig as region, rc, side, 0 as low, length(t) as high from texts, turns, (select unnest(['R', 'L']) as side)),
{_placed('clips', '(select * from asked where clip)', 'cases')},
good as (select cluster, region, rc, max(case when rc = (side = 'L') then start end) as f, max(case when rc <> (side = 'L') then "end" end) as t, sum(score) as clip_total from clips where accepted group by all),
limits as materialized (select c.cluster, c.region, c.rc, c.side, c.low as l0, c.high as h0, coalesce(f, c.low) as low, coalesce(t, c.high) as high, coalesce(clip_total, 0) as clip_total from cases c left join good g using (cluster, region, rc)),
{_placed('placed0', '(select * from asked where not clip)', 'limits')},
wide as (select cluster, region, rc, side from placed0 group by all having max("end") - min(start) > {_LONGEST}),
sums as (select p.*, sum(score) over w as s, min(start) over w as f from placed0 p semi join wide using (cluster, region, rc, side) window w as (partition by cluster, region, rc, side order by start range between {_LONGEST} preceding and current row)),
bests as (select cluster, region, rc, side, min(struct_pack(s := -s, start := start, f := f)) as b from sums group by all),
edges as (select cluster, region, rc, side, any_value(b.f) as a, max("end") as b from bests join sums using (cluster, region, rc, side) where start = b.start group by all),
roomy as (select e.*, l.low as f, l.high as t, case when exists (select 1 from asked q where q.clip and q.cluster = e.cluster and q.side = e.side) then greatest({_LONGEST} - (e.b - e.a), 0) else 0 end as room from edges e join limits l using (cluster, region, rc, side)),
windows as materialized (select cluster, region, rc, side, case when rc = (side = 'L') then greatest(a - room, least(a, f)) else a end as low, case when rc <> (side = 'L') then least(b + room, greatest(b, t)) else b end as high from roomy),
{_placed('placed1', 'asked', 'windows')},
placed as (select * from placed0 anti join windows using (cluster, region, rc, side) union all select * from clips anti join windows using (cluster, region, rc, side) union all select * from placed1),
starts as (select cluster, region, rc, min(struct_pack(n := -n, v := v)).v as v from (select cluster, region, rc, start as v, count(*) as n from placed where not clip and lclip group by all) group by all),
ends as (select cluster, region, rc, -min(struct_pack(n := -n, v := v)).v as v from (select cluster, region, rc, -"end" as v, count(*) as n from placed where not clip and rclip group by all) group by all),
modes as (
  select distinct l.cluster, l.region, l.rc, clip_total, case when low = l0 then coalesce(s.v, low) else low end as f, case when high = h0 then coalesce(e.v, high) else high end as t
  from limits l left join starts s using (cluster, region, rc) left join ends e using (cluster, region, rc)
),
judged as (
  select p.*, m.clip_total, accepted and (clip or not (lclip and f < start - 5 or "end" < f or rclip and "end" + 5 < t or t < start)) as ok from placed p join modes m using (cluster, region, rc)
),
sides as (
  select cluster, region, rc, side, coalesce(min(start) filter (ok and clip), min(start) filter (ok)) as s, coalesce(max("end") filter (ok and clip), max("end") filter (ok)) as e, coalesce(sum(score) filter (ok and not clip), 0) as t, count(*) filter (ok and not clip) as n
  from judged group by all
),
whole as (select cluster, region, rc, max(case when rc = (side = 'L') then s end) as first, max(case when rc <> (side = 'L') then e end) as last, sum(t) as t, sum(n) as accepted from sides group by all),
scores as (
  select m.cluster, m.region, m.rc, cast(coalesce(t2.t, 0) + clip_total as bigint) as total, cast(coalesce(accepted, 0) as bigint) as accepted, reads, first, last
  from modes m left join whole t2 using (cluster, region, rc) join (select cluster, count(*) filter (not clip) as reads from members group by cluster) using (cluster)
)"""


def _scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    members, regions, reference = _tables(spark, sf_dir)
    tables = Scratch(spark, "regions", light=True)
    regions, reference = tables.table(regions, "regions"), tables.table(reference, "reference")
    scores, judged = score_regions(members, regions, reference, _LONGEST, _CHUNK, tables, scoring=_EXACT, clip_scoring=_EXACT, least=_LEAST, least_clip=_CLIP, k=8, w=4)
    return scores, judged, regions


@query("scored_regions", _SCORES + " select * replace (coalesce(first, -1) as first, coalesce(last, -1) as last) from scores")
def scored_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total scores and extents of each cluster's regions in both orientations, from where its clips and mates are placed."""
    return _scored(spark, sf_dir)[0].fillna(-1, ["first", "last"])


@query("placed_mates", _SCORES + ' select cluster, region, rc, side, member, clip, cast(score as integer) as score, start, "end", ok as accepted from judged')
def placed_mates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each mate is placed in its cluster's regions, and whether that counts."""
    return _scored(spark, sf_dir)[1]


@query(
    "chosen_regions",
    _SCORES
    + """, turned as (select cluster, region, min(struct_pack(t := -total, rc := rc, accepted := accepted, first := first, last := last)) as b from scores group by all)
select turned.cluster as cluster, region, b.rc as rc, -b.t as total, b.accepted as accepted, coalesce(b.first, -1) as first, coalesce(b.last, -1) as last, cast(row_number() over (partition by turned.cluster order by b.t, length(texts.t), region) as integer) as rank from turned join texts on contig = region""",
)
def chosen_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions in the better of their orientations, ranked in their cluster."""
    scores, _, regions = _scored(spark, sf_dir)
    return best_regions(scores, regions, 1000).fillna(-1, ["first", "last"]).select("cluster", "region", "rc", "total", "accepted", "first", "last", "rank")
