"""Queries on alignment records: flags, routes, CIGARs, qualities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import cigar as C
from spanloom.functions import flags as P
from spanloom.functions import sequences as S
from spanloom.operators.intervals import contained_counts, overlaps_any
from spanloom.operators.clustering import first_come
from spanloom.plans.registry import alignments, digits_dna, digits_dna_sql, dna, dna_sql, points, query, reads, table

_DISCORDANT = "(contig <> mate_contig or abs(isize) > 100000 or (flag & 4 <> 0) <> (flag & 8 <> 0))"


@query("discordant_filter", f"with {{READS}}, {{ALIGNMENTS}} select rid, flag, isize from alignments where {_DISCORDANT} and flag & 2304 = 0 and (mapq >= 6 or mate_mapq >= 6 or flag & 4 <> 0)")
def discordant_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Primary discordant reads that are mapped well at one end or not at all."""
    a = alignments(spark, sf_dir)
    far = P.is_discordant(F.col("flag"), F.col("contig"), F.col("mate_contig"), F.col("isize"))
    good = (F.col("mapq") >= 6) | (F.col("mate_mapq") >= 6) | P.is_unmapped(F.col("flag"))
    return a.where(far & P.is_primary(F.col("flag")) & good).select("rid", "flag", "isize")


_LEFT, _RIGHT = "coalesce(try_cast(regexp_extract(cigar, '^(\\d+)S', 1) as integer), 0)", "coalesce(try_cast(regexp_extract(cigar, '(\\d+)S$', 1) as integer), 0)"


@query(
    "route_reads",
    f"""with {{READS}}, {{ALIGNMENTS}} select rid,
  case when flag & 4 = 0 and mapq >= mate_mapq and flag & 16 <> 0 and not {_RIGHT} >= 15 then 'L' when flag & 4 = 0 and mapq >= mate_mapq and flag & 16 = 0 and not {_LEFT} >= 15 then 'R' end as stable,
  case when mapq <= mate_mapq or flag & 4 <> 0 then mate_contig end as sent_to,
  case when contig = mate_contig then okey || '_' || case when flag & 64 <> 0 then 1 else 2 end else cast(okey as varchar) end as mate_key,
  flag & 4 = 0 and ({_LEFT} >= 15 or {_RIGHT} >= 15) as clipped from alignments""",
)
def route_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each read goes: the stable end's side, its mate's contig, the clipped reads."""
    a = alignments(spark, sf_dir)
    flag, cigar = F.col("flag"), F.col("cigar")
    return a.select(
        "rid",
        P.stable_end(flag, cigar, F.col("mapq"), F.col("mate_mapq"), 15).alias("stable"),
        F.when((F.col("mapq") <= F.col("mate_mapq")) | P.is_unmapped(flag), F.col("mate_contig")).alias("sent_to"),
        P.mate_key(F.col("okey").cast("string"), flag, P.is_same_contig(F.col("contig"), F.col("mate_contig"))).alias("mate_key"),
        (P.is_left_clipped(flag, cigar, 15) | P.is_right_clipped(flag, cigar, 15)).alias("clipped"),
    )


@query(
    "flag_predicates",
    """with {READS}, {ALIGNMENTS} select flag, count(*) as n, flag & 4 <> 0 as unmapped, flag & 8 <> 0 as mate_unmapped, flag & 2304 = 0 as is_primary, flag & 2304 = 0 and flag & 2 <> 0 as proper,
  (flag & 16) = (flag & 32) as same_strand from alignments group by flag""",
)
def flag_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("flag")
    counts = alignments(spark, sf_dir).groupBy("flag").agg(F.count("*").alias("n"))
    return counts.select("flag", "n", P.is_unmapped(flag).alias("unmapped"), P.is_mate_unmapped(flag).alias("mate_unmapped"), P.is_primary(flag).alias("is_primary"), P.is_proper_pair(flag).alias("proper"), P.is_same_strand(flag).alias("same_strand"))


def _total(kinds: str, column: str = "cigar") -> str:
    return f"cast(coalesce(list_sum(list_transform(regexp_extract_all({column}, '(\\d+)[{kinds}]', 1), lambda x: cast(x as bigint))), 0) as integer)"


@query(
    "cigar_parse_lengths",
    f"""with {{READS}}, {{ALIGNMENTS}} select rid, {_total("MDN=X")} as ref_len, {_total("MIS=X")} as query_len, {_LEFT} as lclip, {_RIGHT} as rclip, s + {_total("MDN=X")} as ref_end,
  s - {_LEFT} as ustart, s + {_total("MDN=X")} + {_RIGHT} as uend, case when mate_cigar is null then e else e + {_total("MDNHP=X", "mate_cigar")} - 1 end as mate_last,
  coalesce(regexp_matches(mate_cigar, '^\\d+S') and regexp_matches(mate_cigar, 'S$'), false) as mate_clipped from alignments""",
)
def cigar_parse_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, m = F.col("cigar"), F.col("mate_cigar")
    return alignments(spark, sf_dir).select(
        "rid", C.reference_length(c).alias("ref_len"), C.query_length(c).alias("query_len"), C.left_clip(c).alias("lclip"), C.right_clip(c).alias("rclip"), C.end_position(F.col("s"), c).alias("ref_end"),
        C.unclipped_start(F.col("s"), c).alias("ustart"), C.unclipped_end(F.col("s"), c).alias("uend"), C.mate_end(F.col("e"), m).alias("mate_last"), P.is_mate_clipped(m).alias("mate_clipped"),
    )


@query("reverse_complement", f"select doc_id, translate(reverse({dna_sql('text')}), 'ACGTacgt', 'TGCATGCA') as rc from documents")
def reverse_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", S.reverse_complement(dna(F.col("text"))).alias("rc"))


def _count(base: str) -> str:
    return f"(length(q) - length(replace(q, '{base}', '')))"


@query("homopolymer_flag", f"with x as (select o_orderkey, {digits_dna_sql('o_orderkey')} as q from orders) select o_orderkey, greatest({_count('A')}, {_count('C')}, {_count('G')}, {_count('T')}) * 10 >= length(q) * 8 as homopolymer from x")
def homopolymer_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", S.is_homopolymer(digits_dna(F.col("o_orderkey"))).alias("homopolymer"))


@query("mean_quality", "select o_orderkey, list_sum(list_transform(regexp_extract_all(o_orderpriority || o_orderkey, '.'), lambda c: ascii(c) - 33)) / cast(length(o_orderpriority || o_orderkey) as double) as quality from orders")
def mean_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", S.mean_quality(F.concat("o_orderpriority", F.col("o_orderkey").cast("string"))).alias("quality"))


@query("hamming_mismatches", "select o_orderkey, hamming(lpad(cast(o_orderkey as varchar), 12, '0'), lpad(cast(o_custkey as varchar), 12, '0')) as mismatches from orders")
def hamming_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    pad = lambda c: F.lpad(F.col(c).cast("string"), 12, "0")
    return table(spark, sf_dir, "orders").select("o_orderkey", S.hamming(pad("o_orderkey"), pad("o_custkey")).cast("long").alias("mismatches"))


_HELD = "with {READS}, {POINTS}, short as (select * from reads where qty <= 10), held as (select pid, rid, s, e, p from points join short on points.contig = short.contig and p <= s and e <= p + 10)"


def _short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(spark, sf_dir).where("qty <= 10").select("rid", "contig", "s", "e")


def _held(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Distinct places of reads within distinct windows, and what each position's window holds: pid, contig, p, n, offsets."""
    windows = points(spark, sf_dir).select("pid", "contig", "p", (F.col("p") + 10).alias("q"))
    held = contained_counts(_short(spark, sf_dir), windows, ["contig"], "s", "e", "p", "q", 16)
    sizes = held.groupBy("contig", "p").agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("s") - F.col("p"))).alias("offsets"))
    return held, windows.drop("q").join(sizes, ["contig", "p"])


@query("interval_containment_join", _HELD + " select pid, count(*) as n, cast(sum(s - p) as bigint) as offsets from held group by pid")
def interval_containment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short reads that lie within each position's window."""
    return _held(spark, sf_dir)[1].groupBy("pid").agg(F.sum("n").alias("n"), F.sum("offsets").alias("offsets"))


@query("first_come_assignment", _HELD + ", sizes as (select pid, count(*) as n from held group by pid) select rid, s, pid from (select rid, s, pid, row_number() over (partition by rid, s order by n desc, pid) as k from held join sizes using (pid)) where k = 1")
def first_come_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each read goes to the largest window that holds it. Of windows at one place only the first can be it, and reads of one place
    have the same candidates."""
    held, windows = _held(spark, sf_dir)
    rank = [F.desc("n"), F.col("pid")]
    sizes = windows.groupBy("pid").agg(F.sum("n").alias("n"))
    best = first_come(windows.drop("n", "offsets").join(sizes, "pid"), ["contig", "p"], rank)
    best = first_come(held.select("contig", "s", "e", "p").join(best, ["contig", "p"]), ["contig", "s", "e"], rank).drop("p")
    return first_come(_short(spark, sf_dir).join(best, ["contig", "s", "e"]), ["rid", "s"], rank).select("rid", "s", "pid")


@query("interval_overlap_semi", "with {READS}, {POINTS} select rid, s, e from reads r where exists (select 1 from points p where p.contig = r.contig and p.p < r.e and r.s < p.p + 1 + p.pid % 2)")
def interval_overlap_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads that overlap a short interval at some position."""
    right = points(spark, sf_dir).select("contig", F.col("p").alias("a"), (F.col("p") + 1 + F.pmod("pid", F.lit(2))).alias("b"))
    return overlaps_any(reads(spark, sf_dir), right, ["contig"], "s", "e", "a", "b").select("rid", "s", "e")


@query("interval_overlap_anti", "with {READS}, {POINTS} select rid, s, e from reads r where not exists (select 1 from points p where p.contig = r.contig and p.p < r.e and r.s < p.p + 1 + p.pid % 2)")
def interval_overlap_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    right = points(spark, sf_dir).select("contig", F.col("p").alias("a"), (F.col("p") + 1 + F.pmod("pid", F.lit(2))).alias("b"))
    return overlaps_any(reads(spark, sf_dir), right, ["contig"], "s", "e", "a", "b", anti=True).select("rid", "s", "e")


@query("dictionary_encode", "with ids as (select n_name, row_number() over (order by n_nationkey) - 1 as id from nation) select c_custkey, id as contig_id from customer join nation on c_nationkey = n_nationkey join ids using (n_name)")
def dictionary_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as numbers in file order. The dictionary has a row for each contig name."""
    from spanloom.operators.calls import sequential_ids

    nation = table(spark, sf_dir, "nation")
    ids = sequential_ids(nation.select("n_nationkey", "n_name"), ["n_nationkey"], "").select("n_nationkey", F.col("id").cast("long").alias("contig_id"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    return customer.join(ids, "n_nationkey").select("c_custkey", "contig_id")


@query("subsample_by_hash", "with {READS} select contig, w, rid from (select contig, s // 100 as w, rid, row_number() over (partition by contig, s // 100 order by md5(rid || ':0'), rid, qty) as k from reads) where k <= 15")
def subsample_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifteen reads of each window in an order that is arbitrary but fixed by the seed."""
    from spanloom.operators.sampling import limit_per_window

    hashed = reads(spark, sf_dir).withColumn("w", F.expr("s div 100")).withColumn("h", F.md5(F.concat("rid", F.lit(":0")).cast("binary")))
    return limit_per_window(hashed, ["contig", "w"], ["h", "rid", "qty"], 15).select("contig", "w", "rid")
