"""Queries of the discordant path: clusters, candidate regions, remapped mates and alignments to a region."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import alignments as A
from spanloom.functions import cigar as C
from spanloom.functions import flags as P
from spanloom.operators import remap as R
from spanloom.plans.registry import alignments, query, reads, table

_OPS = r"list_zip(regexp_extract_all(cigar, '(\d+)([MIDNSHP=X])', 1), regexp_extract_all(cigar, '(\d+)([MIDNSHP=X])', 2))"
_REF = f"cast(coalesce(list_sum(list_transform(list_filter({_OPS}, lambda x: x[2] in ('M', 'D', 'N', '=', 'X')), lambda x: cast(x[1] as bigint))), 0) as bigint)"
_INSERTED = f"cast(coalesce(list_sum(list_transform(list_filter({_OPS}, lambda x: x[2] = 'I'), lambda x: cast(x[1] as bigint))), 0) as bigint)"
_LEFT, _RIGHT = r"coalesce(try_cast(regexp_extract(cigar, '^(\d+)S', 1) as bigint), 0)", r"coalesce(try_cast(regexp_extract(cigar, '(\d+)S$', 1) as bigint), 0)"


def _long(c: Column) -> Column:
    return c.cast("long")


@query("read_endpoints", f"with {{READS}}, {{ALIGNMENTS}} select rid, case when flag & 16 <> 0 then s else s + {_REF} end as endpoint from alignments")
def read_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The end of each read that points at its mate."""
    return alignments(spark, sf_dir).select("rid", _long(A.endpoint(F.col("flag"), F.col("s"), F.col("cigar"))).alias("endpoint"))


@query("projected_reads", f"with {{READS}}, {{ALIGNMENTS}} select rid, s as start, s + {_REF} as last, {_LEFT} as left_clip, {_RIGHT} as right_clip, s - {_LEFT} as unclipped_start, s + {_REF} + {_RIGHT} as unclipped_end, flag & 16 <> 0 as reverse from alignments where {_LEFT} >= 15 or {_RIGHT} >= 15")
def projected_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The few fields of a clipped read that clustering needs."""
    pos, cigar = F.col("s"), F.col("cigar")
    clipped = alignments(spark, sf_dir).where((C.left_clip(cigar) >= 15) | (C.right_clip(cigar) >= 15))
    return clipped.select(
        "rid", pos.alias("start"), _long(C.end_position(pos, cigar)).alias("last"), _long(C.left_clip(cigar)).alias("left_clip"), _long(C.right_clip(cigar)).alias("right_clip"),
        _long(C.unclipped_start(pos, cigar)).alias("unclipped_start"), _long(C.unclipped_end(pos, cigar)).alias("unclipped_end"), P.is_reverse(F.col("flag")).alias("reverse"),
    )


_SIDE = f"case when {_LEFT} >= 15 and {_RIGHT} < 15 and s + {_REF} + {_RIGHT} < 2000 then 'L' when {_RIGHT} >= 15 and {_LEFT} < 15 and s - {_LEFT} >= 0 then 'R' end"


@query("clip_sides", f"with {{READS}}, {{ALIGNMENTS}} select rid, {_SIDE} as side from alignments where {_SIDE} is not null")
def clip_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads clipped on one side, whose clip stays on a contig of 2,000 bases."""
    a = alignments(spark, sf_dir).withColumn("side", P.clip_side(F.col("s"), F.col("cigar"), F.lit(2000), 15))
    return a.where("side is not null").select("rid", "side")


@query(
    "insert_size_pairs",
    "with {READS}, {ALIGNMENTS} select rid, isize from alignments where flag & 2306 = 2 and isize > 0 and isize < 20000 and not contains(cigar, 'S') and mate_cigar is not null and not contains(mate_cigar, 'S')",
)
def insert_size_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs from which insert sizes are sampled: proper, primary, not too long and without clips."""
    a = alignments(spark, sf_dir)
    return a.where(P.is_sampled_pair(F.col("flag"), F.col("isize"), F.col("cigar"), F.col("mate_cigar"))).select("rid", "isize")


@query(
    "pair_spans",
    f"""with {{READS}}, {{ALIGNMENTS}} select rid, isize from alignments where isize > 0 and isize <= 50000 and contig = mate_contig and (flag & 16) <> (flag & 32) and {_LEFT} = 0 and {_RIGHT} = 0
and not coalesce(regexp_matches(mate_cigar, '^\\d+S') and regexp_matches(mate_cigar, 'S$'), false)""",
)
def pair_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that may cross a position: one contig, opposite strands, unclipped, not too long."""
    a = alignments(spark, sf_dir)
    return a.where(P.is_spanning_pair(F.col("flag"), F.col("contig"), F.col("mate_contig"), F.col("isize"), F.col("cigar"), F.col("mate_cigar"), 50_000)).select("rid", "isize")


@query("semi_mapped_reads", "with {READS}, {ALIGNMENTS} select rid from alignments where flag & 2306 = 2 and not coalesce(regexp_matches(mate_cigar, '^\\d+S') and regexp_matches(mate_cigar, 'S$'), false)")
def semi_mapped_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proper reads whose mate is not clipped."""
    return alignments(spark, sf_dir).where(P.is_proper_pair(F.col("flag")) & ~P.is_mate_clipped(F.col("mate_cigar"))).select("rid")


@query("small_cluster_drop", "with {READS} select okey, contig, count(*) as n, min(s) as low from reads group by okey, contig having count(*) > 1")
def small_cluster_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of one read are no evidence."""
    return reads(spark, sf_dir).groupBy("okey", "contig").agg(F.count("*").alias("n"), F.min("s").alias("low")).where("n > 1")


@query("transposed_admission", "with {READS} select okey, contig, cast(sum(mapq) as bigint) as rights, cast(sum(nm) as bigint) as lefts from reads group by okey, contig having sum(mapq) > 1 and sum(nm) > 1")
def transposed_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls with more than one piece of evidence on both sides."""
    found = reads(spark, sf_dir).groupBy("okey", "contig").agg(F.sum("mapq").alias("rights"), F.sum("nm").alias("lefts"))
    return found.where("rights > 1 and lefts > 1")


@query(
    "cluster_merge_candidates",
    """with {READS}, c as (select okey, contig, rid, ln, strand, s, e, nm from reads)
select a.rid || ':' || a.s as a, b.rid || ':' || b.s as b, greatest(a.e, b.e) - a.s as distance from c a join c b on a.okey = b.okey and a.contig = b.contig and a.strand = b.strand and b.s between a.s and a.s + 60
where (b.s > a.s or a.rid || ':' || a.s < b.rid || ':' || b.s) and greatest(a.e, b.e) - a.s <= 60
and (a.nm = 0 or case when a.strand = 'F' then a.s <= b.s + 5 else a.e >= b.e - 5 end) and (b.nm = 0 or case when a.strand = 'F' then b.s <= a.s + 5 else b.e >= a.e - 5 end)""",
)
def cluster_merge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of clusters that may merge: near, and not beyond an end that clips hold."""
    c = reads(spark, sf_dir).select("okey", "contig", F.concat("rid", F.lit(":"), "s").alias("c"), F.when(F.col("strand") == "F", "L").otherwise("R").alias("dir"), F.col("s").alias("start"), F.col("e").alias("end"), F.col("nm").alias("clips"))
    return R.merge_candidates(c, ["okey", "contig"], "c", 60)


@query(
    "cluster_bounds",
    """with {READS}, r as (select okey, contig, min(s) as rs, max(e) as re, min(case when nm = 8 then s + 3 end) as cs, max(case when nm = 8 then e - 3 end) as ce, case when okey % 2 = 0 then 'L' else 'R' end as dir from reads group by okey, contig)
select okey, contig, case when dir = 'L' and cs is not null then cs else least(rs, coalesce(cs, rs)) end as low, case when dir = 'R' and ce is not null then ce else greatest(re, coalesce(ce, re)) end as high from r""",
)
def cluster_bounds_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of clusters, where a clip decides on the side of its direction."""
    clip = F.col("nm") == 8
    r = reads(spark, sf_dir).groupBy("okey", "contig").agg(F.min("s").alias("rs"), F.max("e").alias("re"), F.min(F.when(clip, F.col("s") + 3)).alias("cs"), F.max(F.when(clip, F.col("e") - 3)).alias("ce"))
    low, high = R.cluster_bounds(F.when(F.col("okey") % 2 == 0, "L").otherwise("R"), F.col("rs"), F.col("re"), F.col("cs"), F.col("ce"))
    return r.select("okey", "contig", low.alias("low"), high.alias("high"))


@query("best_clip_per_cluster", "with {READS} select okey, contig, s, e, nm from (select *, row_number() over (partition by okey, contig order by nm desc, s, e) as k from reads) where k = 1")
def best_clip_per_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clip with most reads, the first of equals."""
    return R.best_by(reads(spark, sf_dir), ["okey", "contig"], "nm", ["s", "e"], ["s", "e", "nm"])


@query(
    "mate_regions",
    """with {READS}, r as (select okey, contig, min(case when strand = 'F' then s end) as b, max(case when strand <> 'F' then s end) as f from reads group by okey, contig)
select okey, contig, greatest(0, least(coalesce(b - 40, f - 300), coalesce(f - 300, b - 40))) as low, least(2500, greatest(coalesce(b + 300, f + 40), coalesce(f + 40, b + 300))) as high from r""",
)
def mate_regions_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the mates of a subcluster say that its inserted sequence comes from."""
    r = reads(spark, sf_dir).select("okey", "contig", "s", (F.col("strand") == "F").alias("reverse"), F.lit(2500).cast("long").alias("n"))
    return R.mate_regions(r, ["okey", "contig"], "s", "reverse", "n", 40, 300)


_OK = "(qty >= 30 and not (e < 400 or s > 2000) and not ((qty % 5 = 0 and 400 < s - 5) or (nm % 4 = 1 and e + 5 < 2000)))"


@query("remap_accepted", f"with {{READS}} select rid, s, {_OK} as accepted from reads")
def remap_accepted_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remapped mates that count: scored well, inside strict limits, clipped only where those are."""
    return reads(spark, sf_dir).select("rid", "s", _accepted().alias("accepted"))


def _accepted() -> Column:
    cigar = F.concat(F.when(F.col("qty") % 5 == 0, "9S").otherwise(""), F.lit("30M"), F.when(F.col("nm") % 4 == 1, "9S").otherwise(""))
    return A.remap_accepted(F.col("qty"), F.col("s"), F.col("e"), cigar, F.lit(400), F.lit(2000))


_SCORES = f"""scored as (select okey, contig, {_OK} as accepted, qty as score, s, e, ln = 1 as clip from reads),
regions as (select okey, contig, cast(coalesce(sum(case when accepted then score end), 0) as bigint) as total, count(case when accepted then 1 end) as accepted, count(case when not clip then 1 end) as reads,
  coalesce(min(case when accepted and clip then s end), min(case when accepted then s end)) as first, coalesce(max(case when accepted and clip then e end), max(case when accepted then e end)) as last from scored group by okey, contig)"""


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reads(spark, sf_dir).select("okey", "contig", _accepted().alias("accepted"), F.col("qty").alias("score"), F.col("s").alias("start"), F.col("e").alias("end"), (F.col("ln") == 1).alias("clip"))
    return R.region_scores(rows, ["okey", "contig"])


@query("region_scores", f"with {{READS}}, {_SCORES} select * replace (coalesce(first, -1) as first, coalesce(last, -1) as last), accepted / nullif(cast(reads as double), 0) as share from regions")
def region_scores_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total score, accepted share and extent (-1 where nothing is accepted) of each candidate region."""
    return _regions(spark, sf_dir).fillna(-1, ["first", "last"])


@query("base_region_veto", f"with {{READS}}, {_SCORES} select okey, contig, total >= 40 * 0.95 and coalesce(accepted / nullif(cast(reads as double), 0) >= 0.5, false) as explained from regions")
def base_region_veto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters whose own region explains their mates."""
    r = _regions(spark, sf_dir)
    return r.select("okey", "contig", R.explained_by_own_region(F.col("total"), F.lit(40), F.col("accepted"), F.col("reads")).alias("explained"))


@query("assembly_trigger", f"with {{READS}}, {_SCORES} select okey, contig, accepted = 0 or reads = 0 or coalesce((accepted + reads) / nullif(cast(3 * reads as double), 0) < 0.5, false) as assemble from regions")
def assembly_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters that too few accepted mates explain."""
    return _regions(spark, sf_dir).select("okey", "contig", R.wants_assembly(F.col("accepted"), F.col("reads"), 3 * F.col("reads")).alias("assemble"))


@query("average_mismatches", "with {READS} select okey, contig, avg(case when mapq >= 3 then nm end) as average from reads group by okey, contig")
def average_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean edit distance of the supporting reads; null without any."""
    return reads(spark, sf_dir).groupBy("okey", "contig").agg(F.avg(F.when(F.col("mapq") >= 3, F.col("nm"))).alias("average"))


@query("inserted_bases", f"with {{READS}}, {{ALIGNMENTS}} select rid, {_INSERTED} as inserted from alignments")
def inserted_bases_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments(spark, sf_dir).select("rid", _long(A.inserted_bases(F.col("cigar"))).alias("inserted"))


@query("fully_aligned", f"with {{READS}}, {{ALIGNMENTS}} select rid, ln * 3 < 15 and qty + 40 > 80 - 1 - 15 and {_INSERTED} < 3 as whole, ln * 3 = 0 and qty + 40 - ln * 3 >= 22 as left_anchor, qty + 40 = 79 and qty + 40 - ln * 3 >= 22 as right_anchor from alignments")
def fully_aligned_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments that cover their query, and those with good anchors."""
    begin, end, size = F.col("ln") * 3, F.col("qty") + 40, F.lit(80)
    whole = A.fully_aligned(F.col("cigar"), begin, end, size, least_insertion=3)
    return alignments(spark, sf_dir).select("rid", whole.alias("whole"), A.good_anchor(begin, end, size, True).alias("left_anchor"), A.good_anchor(begin, end, size, False).alias("right_anchor"))


_PAD = f"(greatest(7 - {_LEFT}, 0) + greatest(7 - {_RIGHT}, 0))"


@query("accepted_alignments", f"with {{READS}}, {{ALIGNMENTS}} select rid, cigar, {_LEFT} <= 7 and {_RIGHT} <= 7 and coalesce((nm + 10 - {_PAD}) / nullif(cast(ln * 10 + 40 - {_PAD} as double), 0) <= 0.05, false) as accepted from alignments")
def accepted_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments of padded sequences that count: not clipped beyond the padding, few mismatches."""
    return alignments(spark, sf_dir).select("rid", "cigar", A.accepts(F.col("cigar"), F.lit(0), F.col("ln") * 10 + 40, F.col("nm") + 10, 0.05).alias("accepted"))


@query("packed_cigars", f"with {{READS}}, {{ALIGNMENTS}} select rid, array_to_string(list_transform({_OPS}, lambda x: cast(cast(x[1] as bigint) * 16 + instr('MIDNSHP=X', x[2]) - 1 as varchar)), ',') as packed, cigar as back from alignments")
def packed_cigars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CIGARs as numbers and back."""
    packed = A.pack_cigar(F.col("cigar"))
    return alignments(spark, sf_dir).select("rid", F.array_join(packed.cast("array<string>"), ",").alias("packed"), A.unpack_cigar(packed).alias("back"))


@query("region_strings", "with {READS} select rid, contig || ':' || greatest(1, s - 100) || '-' || (s + 100) as region from reads")
def region_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(spark, sf_dir).select("rid", A.region_text(F.col("contig"), F.col("s"), 100).alias("region"))


@query("base_scores", "select n_nationkey as k, r_regionkey as j, case when upper(left(n_name, 1)) = upper(right(r_name, 1)) or left(n_name, 1) = 'N' or right(r_name, 1) = 'N' then 1 else -4 end as score from nation, region where n_regionkey = r_regionkey")
def base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of letters against letters."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    joined = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(F.col("n_nationkey").alias("k"), F.col("r_regionkey").alias("j"), A.base_score(F.substring("n_name", 1, 1), F.right("r_name", F.lit(1)), 1, -4).alias("score"))


@query("sweep_overlaps", "with {READS} select okey, contig, a.rid || ':' || a.s as a, b.rid || ':' || b.s as b, a.e - b.s as overlap from reads a join reads b using (okey, contig) where (b.s > a.s or (b.s = a.s and b.rid || ':' || b.s > a.rid || ':' || a.s)) and a.e - b.s >= 15")
def sweep_overlaps_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps of alignments in order along the reference."""
    r = reads(spark, sf_dir).withColumn("c", F.concat("rid", F.lit(":"), "s"))
    return R.sweep_overlaps(r, ["okey", "contig"], "c", "s", "e", 15, 50)


_CHOSEN = "with recursive {READS}, ranked as (select okey, s, e, row_number() over (partition by okey order by qty desc, s, e, rid) as k from reads), "
_CHOSEN += "walk as (select okey, k, [struct_pack(s := s, e := e)] as kept from ranked where k = 1 union all select r.okey, r.k, case when len(list_filter(w.kept, lambda y: greatest(y.s, r.s) <= least(y.e, r.e))) = 0 then list_append(w.kept, struct_pack(s := r.s, e := r.e)) else w.kept end as kept from walk w join ranked r on r.okey = w.okey and r.k = w.k + 1), "
_CHOSEN += "final as (select okey, kept from (select *, row_number() over (partition by okey order by k desc) as last from walk) where last = 1) select okey, u.s as s, u.e as e from (select okey, unnest(kept) as u from final)"


@query("retain_disjoint", _CHOSEN)
def retain_disjoint_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each order's spans, heaviest first, those that overlap none retained before."""
    r = reads(spark, sf_dir).select("okey", "s", "e", (-F.col("qty")).alias("w"), "rid")
    return R.retain_disjoint(r, ["okey"], "s", "e", ["w", "s", "e", "rid"]).select("okey", "s", "e")


@query("updated_mates", "with {READS}, {ALIGNMENTS} select rid, 'X' as mate_contig, s + 7 as mate_pos, cast(case when qty % 3 = 0 then flag | 32 else flag & ~32 end as integer) as flag, (qty + 9) || 'M' as mate_cigar, case when qty >= 30 then 'T' else 'F' end as ok, qty as ms from alignments")
def updated_mates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads with their mates as remapped."""
    qty = F.col("qty")
    found = R.update_mates(alignments(spark, sf_dir), F.lit("X"), F.col("s") + 7, qty % 3 == 0, F.concat((qty + 9).cast("string"), F.lit("M")), qty, qty >= 30)
    return found.select("rid", "mate_contig", "mate_pos", "flag", "mate_cigar", "ok", "ms")


@query("clamped_size_lookup", "with {READS}, t as (select unnest(range(0, 31)) as size), v as (select size, size * size + 3 as least from t) select rid, s, least from reads join v on size = case when nm = 8 then 30 else least(qty, 30) end")
def clamped_size_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least number of pairs for each call's length; beyond the table, or for incomplete ones, its last row."""
    sizes = spark.range(31).select(F.col("id").alias("size"), (F.col("id") * F.col("id") + 3).alias("least"))
    return R.clamped_lookup(sizes, reads(spark, sf_dir), "qty", "least", 30, F.col("nm") == 8).select("rid", "s", "least")


@query(
    "prefix_score_arrays",
    r"""with recursive {READS}, {ALIGNMENTS}, rows as (select rid, s, translate(cigar, 'M', '=') as cigar from alignments),
ops as (select rid, s, list_filter(""" + _OPS + r""", lambda x: cast(x[1] as integer) > 0) as o from rows),
walk as (select rid, s, o, 1 as i, 0 as score, [0] as out from ops
  union all select rid, s, o, i + 1, score + case when o[i][2] = '=' then cast(o[i][1] as integer) when o[i][2] = 'X' then -4 * cast(o[i][1] as integer) when o[i][2] in ('D', 'I') then -6 - cast(o[i][1] as integer) else 0 end,
    case when o[i][2] in ('=', 'X', 'D') then list_concat(out, list_transform(range(1, cast(o[i][1] as integer) + 1), lambda k: cast(score + k * case when o[i][2] = '=' then 1 when o[i][2] = 'X' then -4 else 0 end as integer))) else out end from walk where i <= len(o))
select rid, s, cast(list_max(out) as bigint) as best, cast(len(out) as bigint) as n, array_to_string(list_transform(out, lambda x: cast(x as varchar)), ',') as scores from walk where i = len(o) + 1""",
)
def prefix_score_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running alignment scores along the reference."""
    a = alignments(spark, sf_dir).select("rid", "s", F.translate("cigar", "M", "=").alias("cigar"))
    # many reads have one CIGAR, whose scores are worked out once
    x = a.select("cigar").distinct().select(F.col("cigar").alias("c"), A.prefix_scores(F.col("cigar")).alias("x"))
    scores = x.select("c", _long(F.array_max("x")).alias("best"), _long(F.size("x")).alias("n"), F.array_join(F.col("x").cast("array<string>"), ",").alias("scores"))
    return a.join(scores, F.col("cigar").eqNullSafe(F.col("c"))).select("rid", "s", "best", "n", "scores")


@query("cluster_read_union", "with {READS}, c as (select okey, list(rid order by rid) filter (strand = 'F') as r, list(rid order by rid) filter (strand <> 'F') as l from reads group by okey) select okey, array_to_string(list_concat(coalesce(r, []), coalesce(l, [])), ' ') as members from c")
def cluster_read_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reads of a cluster pair, right ones first."""
    side = lambda forward: F.array_sort(F.collect_list(F.when((F.col("strand") == "F") == F.lit(forward), F.col("rid"))))
    found = reads(spark, sf_dir).groupBy("okey").agg(side(True).alias("r"), side(False).alias("l"))
    return found.select("okey", F.array_join(F.concat("r", "l"), " ").alias("members"))


@query("start_offsets", f"with {{READS}}, {{ALIGNMENTS}}, x as (select okey, contig, rid, s, s - {_LEFT} as us, cigar, row_number() over (partition by okey, contig order by s - {_LEFT}, rid) as k from alignments where not regexp_matches(cigar, '[ID]')) select x.rid, x.s, x.us - f.us as shift from x join x f on x.okey = f.okey and x.contig = f.contig and f.k = 1")
def start_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where reads without indels begin on their cluster's first read; tests cover those with them."""
    a = alignments(spark, sf_dir).where(~F.col("cigar").rlike("[ID]")).withColumn("us", C.unclipped_start(F.col("s"), F.col("cigar")))
    first = R.best_by(a.withColumn("z", F.lit(0)), ["okey", "contig"], "z", ["us", "rid"], ["us", "cigar"]).withColumnsRenamed({"us": "fus", "cigar": "fc"})
    return a.join(first, ["okey", "contig"]).select("rid", "s", _long(A.start_offset(F.col("fus"), F.col("fc"), F.col("us"))).alias("shift"))
