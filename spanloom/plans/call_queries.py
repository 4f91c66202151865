"""Queries on calls: identifiers, support, filters, suppression, text formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.sequences import fold_microhomology
from spanloom.functions.vcf import info_map, record_line
from spanloom.operators.calls import filters, insertion_filters, sequential_ids, support, suppress
from spanloom.plans.registry import clips, digits_dna, digits_dna_sql, points, query, reads, table


@query("sequential_ids", "with {POINTS} select pid, contig, p, 'S_INS_' || (row_number() over (order by contig, p, pid) - 1) as id from points")
def sequential_ids_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered calls in coordinate order."""
    return sequential_ids(points(spark, sf_dir), ["contig", "p", "pid"], "S_INS_")


_EVIDENCE = "evidence as (select okey, sum(case when strand = 'F' then mapq else 0 end) as disc, sum(case when strand = 'F' then nm else 0 end) as split, sum(case when strand <> 'F' then mapq + nm else 0 end) as against from reads group by okey)"


@query("support_and_scores", f"with {{READS}}, {_EVIDENCE} select okey, cast(disc + split as bigint) as support, cast(disc + split as double) / nullif(disc + split + against, 0) as score from evidence")
def support_and_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supporting evidence and its share of all evidence; null without any."""
    forward = F.col("strand") == "F"
    evidence = reads(spark, sf_dir).groupBy("okey").agg(
        F.sum(F.when(forward, F.col("mapq")).otherwise(0)).alias("disc"), F.sum(F.when(forward, F.col("nm")).otherwise(0)).alias("split"), F.sum(F.when(~forward, F.col("mapq") + F.col("nm")).otherwise(0)).alias("against")
    )
    total, score = support([F.col("disc"), F.col("split")], F.col("against"))
    return evidence.select("okey", total.alias("support"), score.alias("score"))


@query(
    "filter_list",
    """with {READS} select rid, s, coalesce(nullif(array_to_string(list_filter([case when qty < 10 then 'SMALL' end, case when e - s >= 45 then 'ALT_SHORTER_THAN_REF' end, case when mapq >= 9 or mapq < 1 then 'ANOMALOUS_DEPTH' end,
  case when nm = 0 then 'NO_DISC_SUPPORT' end, case when nm <> 0 and nm < mapq // 5 then 'LOW_SUPPORT' end], lambda x: x is not null), ';'), ''), 'PASS') as filter from reads""",
)
def filter_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of the rules that a call breaks, or PASS."""
    named = {
        "SMALL": F.col("qty") < 10, "ALT_SHORTER_THAN_REF": F.col("e") - F.col("s") >= 45, "ANOMALOUS_DEPTH": (F.col("mapq") >= 9) | (F.col("mapq") < 1),
        "NO_DISC_SUPPORT": F.col("nm") == 0, "LOW_SUPPORT": (F.col("nm") != 0) & (F.col("nm") < F.expr("mapq div 5")),
    }
    return reads(spark, sf_dir).select("rid", "s", F.array_join(filters(named), ";").alias("filter"))


@query(
    "suppress_compatible",
    """with {READS}, {POINTS}, passed as (select contig, p as s, p + pid % 50 as e, pid % 50 as length from points)
select rid, contig, s, e from reads r where not exists (select 1 from passed p where p.contig = r.contig and abs(p.s - r.s) + abs(p.e - r.e) <= 4 and abs(p.length - r.qty) <= 4)""",
)
def suppress_compatible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small calls with no compatible call that passed elsewhere."""
    passed = points(spark, sf_dir).select("contig", F.col("p").alias("s"), (F.col("p") + F.pmod("pid", F.lit(50))).alias("e"), F.pmod("pid", F.lit(50)).alias("qty"))
    return suppress(reads(spark, sf_dir), passed, "contig", "s", "e", "qty", 4).select("rid", "contig", "s", "e")


@query(
    "union_calls",
    """with {READS}, {POINTS}, {CLIPS} select contig, s as at, 'T' as kind, rid as id from reads union all select contig, p, 'A', 'A_INS_' || pid from points union all select 'u' || contig, pos, 'S', 'S_INS_' || event_id from clips""",
)
def union_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All kinds of calls in one table."""
    t = reads(spark, sf_dir).select("contig", F.col("s").alias("at"), F.lit("T").alias("kind"), F.col("rid").alias("id"))
    a = points(spark, sf_dir).select("contig", F.col("p").alias("at"), F.lit("A").alias("kind"), F.concat(F.lit("A_INS_"), F.col("pid").cast("string")).alias("id"))
    s = clips(spark, sf_dir).select(F.concat(F.lit("u"), F.col("contig").cast("string")).alias("contig"), F.col("pos").alias("at"), F.lit("S").alias("kind"), F.concat(F.lit("S_INS_"), F.col("event_id").cast("string")).alias("id"))
    return t.unionByName(a).unionByName(s)


@query(
    "microhomology_fold",
    f"""with x as (select o_orderkey, o_orderkey as s, o_orderkey + 5 - o_orderkey % 11 as e, lower({digits_dna_sql('o_custkey * 101')}) as ref, {digits_dna_sql('o_orderkey')} as q from orders),
y as (select *, substr(ref, 1, cast(greatest(s - e, 0) as integer)) as prefix from x)
select o_orderkey, case when s > e then e else s end as start, case when s > e then upper(prefix) || q else q end as seq, greatest(s - e, 0) as mh_len from y""",
)
def microhomology_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insertions whose ends cross: what lies between belongs to the inserted sequence."""
    key = F.col("o_orderkey")
    x = table(spark, sf_dir, "orders").select("o_orderkey", key.alias("s"), (key + 5 - F.pmod(key, F.lit(11))).alias("e"), F.lower(digits_dna(F.col("o_custkey") * 101)).alias("ref"), digits_dna(key).alias("q"))
    prefix = F.col("ref").substr(F.lit(1), F.greatest(F.col("s") - F.col("e"), F.lit(0)).cast("int"))
    return x.select("o_orderkey", fold_microhomology(F.col("s"), F.col("e"), prefix, F.col("q")).alias("f")).select("o_orderkey", "f.*")


@query("info_parse", "select event_id, try_cast(regexp_extract(props, '\"k\": *(-?\\d+)', 1) as bigint) as k, event_type = 'error' as imprecise from events")
def info_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key-value text to typed columns: the properties as an INFO field with a number and a flag."""
    text = F.concat(F.lit("K="), F.regexp_extract("props", '"k": *(-?\\d+)', 1), F.when(F.col("event_type") == "error", F.lit(";IMPRECISE")).otherwise(F.lit("")))
    parsed = table(spark, sf_dir, "events").select("event_id", info_map(text).alias("info"))
    return parsed.select("event_id", F.element_at("info", "K").cast("long").alias("k"), F.map_contains_key("info", "IMPRECISE").alias("imprecise"))


@query(
    "vcf_line_format",
    """with {READS} select rid, s, contig || chr(9) || (s + 1) || chr(9) || rid || chr(9) || 'N' || chr(9) || '<INS>' || chr(9) || '.' || chr(9) || 'PASS' || chr(9) || 'END=' || (e + 1) || ';SVTYPE=INS;SVLEN=' || qty || ';OVERLAP=' || mapq || case when nm = 0 then ';IMPRECISE' else '' end || chr(9) || 'GT' || chr(9) || '1' as line from reads""",
)
def vcf_line_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls as lines of a variant file."""
    info = {"END": F.col("e") + 1, "SVTYPE": F.lit("INS"), "SVLEN": F.col("qty"), "OVERLAP": F.col("mapq"), "IMPRECISE": F.col("nm") == 0}
    line = record_line(F.col("contig"), F.col("s"), F.col("rid"), F.lit("N"), F.lit("<INS>"), F.array(F.lit("PASS")), info, {"IMPRECISE"})
    return reads(spark, sf_dir).select("rid", "s", line.alias("line"))


@query("transposed_order", "with {READS} select rid, s, cast(row_number() over (order by contig, s, e, strand, -(mapq * nm), -(mapq + nm), rid) - 1 as varchar) as place from reads")
def transposed_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assembled and transposed calls in order: place, sequence, then most evidence by product and by sum."""
    r = reads(spark, sf_dir).withColumns({"product": -(F.col("mapq") * F.col("nm")), "total": -(F.col("mapq") + F.col("nm"))})
    return sequential_ids(r, ["contig", "s", "e", "strand", "product", "total", "rid"], "", "place").select("rid", "s", "place")


@query("final_call_order", "with {POINTS}, named as (select contig, p, 'A_INS_' || pid as id from points) select id, cast(row_number() over (order by contig, p, id) - 1 as varchar) as place from named")
def final_call_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written calls in order; identifiers compare as text."""
    named = points(spark, sf_dir).select("contig", "p", F.concat(F.lit("A_INS_"), F.col("pid").cast("string")).alias("id"))
    return sequential_ids(named, ["contig", "p", "id"], "", "place").select("id", "place")


_FILTERED = f"""with {{READS}}, seqs as (
  select *, case ln % 3 when 0 then 'S' when 1 then 'T' else 'A' end as kind, s + nm * 12 as last,
    case when ln = 2 then repeat('ac', cast(qty as integer)) || '-' || {digits_dna_sql('okey * 7919')} when ln = 4 then repeat('g', cast(qty as integer)) else {digits_dna_sql('okey * 1000003')} || repeat('acgt', cast(qty % 20 as integer)) end as seq from reads
),
halves as (select *, length(seq) as n, last - s as gap, case when instr(seq, '-') > 1 then split_part(seq, '-', 1) else seq end as half from seqs),
counts as (select *, length(half) - length(replace(upper(half), 'A', '')) as a, length(half) - length(replace(upper(half), 'C', '')) as c, length(half) - length(replace(upper(half), 'G', '')) as g, length(half) - length(replace(upper(half), 'T', '')) as t from halves)
select rid, s, kind, coalesce(nullif(array_to_string(list_filter([
  case when n - gap >= 0 and n - gap < 50 then 'SMALL' end, case when gap >= n then 'ALT_SHORTER_THAN_REF' end, case when greatest(mapq * 2, nm * 3) > 18 or least(mapq * 2, nm * 3) < 1 then 'ANOMALOUS_DEPTH' end,
  case when a + c + g + t > 0 and greatest(a, c, g, t) * 10 >= (a + c + g + t) * 8 then 'HOMOPOLYMER_INSSEQ' end, case when kind in ('S', 'T') and greatest(ln, nm) > 6 then 'ANOMALOUS_SC_NUMBER' end,
  case when kind in ('T', 'A') and nm % 3 + mapq % 2 = 0 then 'NO_DISC_SUPPORT' end, case when kind in ('T', 'A') and nm % 3 + mapq % 2 > 0 and nm < 4 and mapq < 4 then 'LOW_SUPPORT' end,
  case when kind = 'T' and nm > 1 and nm * 0.1 < 0.25 and mapq * 0.05 < 0.25 then 'LOW_SCORE' end, case when kind = 'T' and mapq * 15 > 100 then 'MH_TOO_LONG' end, case when kind in ('T', 'A') and nm % 3 + mapq % 2 < 2 then 'NOT_ENOUGH_DISC_PAIRS' end,
  case when kind = 'A' and instr(seq, '-') > 0 and instr(seq, '-') - 1 < 60 and n - instr(seq, '-') < 60 then 'LOW_QUAL_ASSEMBLY' end
], lambda x: x is not null), ';'), ''), 'PASS') as filter from counts"""


@query("insertion_filters", _FILTERED)
def insertion_filters_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filters of small, transposed and assembled insertions, for lines as calls of all three kinds."""
    number = lambda x: F.col(x).cast("int")
    one = F.concat(F.repeat(F.lit("ac"), number("qty")), F.lit("-"), digits_dna(F.col("okey") * 7919))
    seq = F.when(F.col("ln") == 2, one).when(F.col("ln") == 4, F.repeat(F.lit("g"), number("qty"))).otherwise(F.concat(digits_dna(F.col("okey") * 1000003), F.repeat(F.lit("acgt"), (number("qty") % 20))))
    rows = reads(spark, sf_dir).withColumn("seq", seq)
    c = {
        "length": F.length("seq"), "start": F.col("s"), "end": F.col("s") + F.col("nm") * 12, "seq": F.col("seq"), "left_depth": F.col("mapq") * 2, "right_depth": F.col("nm") * 3, "min_depth": F.lit(1), "max_depth": F.lit(18),
        "left_split": F.col("ln"), "right_split": F.col("nm"), "global_max_depth": F.lit(6), "left_disc": F.col("nm") % 3, "right_disc": F.col("mapq") % 2, "left_support": F.col("nm"), "right_support": F.col("mapq"), "median_depth": F.lit(20),
        "left_score": F.when(F.col("nm") > 1, F.col("nm") * 0.1), "right_score": F.col("mapq") * 0.05, "mh_len": F.col("mapq") * 15, "min_pairs": F.lit(2),
    }
    kind = F.when(F.col("ln") % 3 == 0, "S").when(F.col("ln") % 3 == 1, "T").otherwise("A")
    found = {k: insertion_filters(k, c, 50, 60) for k in "STA"}
    listed = F.when(kind == "S", found["S"]).when(kind == "T", found["T"]).otherwise(found["A"])
    return rows.select("rid", "s", kind.alias("kind"), F.array_join(listed, ";").alias("filter"))
