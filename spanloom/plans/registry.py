"""Registration of queries and the analogue encodings that let general tables stand in for reads, positions and clips."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_DNA_FROM, _DNA_TO = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function of (spark, sf_dir) and, where SQL can state it, the DuckDB SQL for the same rows."""

    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql.replace("{READS}", READS).replace("{POINTS}", POINTS).replace("{CLIPS}", CLIPS).replace("{PAIRS}", PAIRS).replace("{ALIGNMENTS}", ALIGNMENTS)
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _day(column: str) -> F.Column:
    return F.datediff(F.col(column), F.lit("1995-01-01")).cast("long")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as intervals of days: rid, contig, okey, ln, s, e, strand, mapq, nm, qty."""
    line = table(spark, sf_dir, "lineitem")
    rid = F.concat_ws(".", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    qty = F.col("l_quantity").cast("long")
    return line.select(
        rid.alias("rid"), F.col("l_returnflag").alias("contig"), F.col("l_orderkey").alias("okey"), F.col("l_linenumber").cast("long").alias("ln"), _day("l_shipdate").alias("s"),
        (_day("l_shipdate") + qty).alias("e"), F.col("l_linestatus").alias("strand"), F.round(F.col("l_discount") * 100).cast("long").alias("mapq"), F.round(F.col("l_tax") * 100).cast("long").alias("nm"), qty.alias("qty"),
    )


READS = """reads as (
  select concat_ws('.', l_orderkey, l_linenumber, l_partkey, l_suppkey) as rid, l_returnflag as contig, l_orderkey as okey, cast(l_linenumber as bigint) as ln,
    date_diff('day', timestamp '1995-01-01', l_shipdate) as s, date_diff('day', timestamp '1995-01-01', l_shipdate) + cast(l_quantity as bigint) as e, l_linestatus as strand,
    cast(round(l_discount * 100) as bigint) as mapq, cast(round(l_tax * 100) as bigint) as nm, cast(l_quantity as bigint) as qty
  from lineitem)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as positions: pid, contig, p."""
    contig = F.element_at(F.array(*map(F.lit, "ANR")), (F.pmod("o_orderkey", F.lit(3)) + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pid"), contig.alias("contig"), _day("o_orderdate").alias("p"))


POINTS = """points as (
  select o_orderkey as pid, substr('ANR', cast(o_orderkey % 3 + 1 as integer), 1) as contig, date_diff('day', timestamp '1995-01-01', o_orderdate) as p from orders)"""


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as clip positions in minutes: event_id, contig (the user), pos, kind, v."""
    pos = F.expr("unix_micros(cast(ts as timestamp)) div 60000000").cast("long")
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("contig"), pos.alias("pos"), F.col("event_type").alias("kind"), F.floor(F.col("value")).cast("long").alias("v"))


CLIPS = """clips as (
  select event_id, user_id as contig, epoch_us(ts) // 60000000 as pos, event_type as kind, cast(floor(value) as bigint) as v from events)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose lines lie on one contig as pairs: okey, contig, lo, hi (last day, inclusive), n lines."""
    from spanloom.plans.registry import reads as r

    return r(spark, sf_dir).groupBy("okey", "contig").agg(F.min("s").alias("lo"), (F.max("e") - 1).alias("hi"), F.count("*").alias("n")).where("n >= 2")


PAIRS = """pairs as (select okey, contig, min(s) as lo, max(e) - 1 as hi, count(*) as n from reads group by okey, contig having count(*) >= 2)"""


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with flags, CIGARs and mates as alignment records have them."""
    flag = (
        F.lit(1) + F.when(F.col("qty") % 2 == 0, 2).otherwise(0) + F.when(F.col("mapq") == 0, 4).otherwise(0) + F.when(F.col("nm") == 8, 8).otherwise(0) + F.when(F.col("strand") == "F", 16).otherwise(0)
        + F.when(F.col("ln") % 2 == 0, 32).otherwise(0) + F.when(F.col("ln") % 2 == 1, 64).otherwise(128) + F.when(F.col("qty") >= 48, 256).otherwise(0) + F.when(F.col("qty") == 1, 2048).otherwise(0)
    )
    cigar = F.concat(
        F.when(F.col("qty") % 5 == 0, F.concat(F.col("qty").cast("string"), F.lit("S"))).otherwise(""), (F.col("ln") * 10 + 20).cast("string"), F.lit("M"),
        F.when(F.col("mapq") % 3 == 0, "2D5M").when(F.col("mapq") % 3 == 1, "3I7M").otherwise(""), F.when(F.col("nm") % 4 == 1, F.concat((F.col("nm") + 12).cast("string"), F.lit("S"))).otherwise(""),
    )
    mate_cigar = F.when(F.col("nm") % 3 == 0, None).otherwise(F.concat(F.when(F.col("ln") % 3 == 0, "4S").otherwise(""), (F.col("qty") + 30).cast("string"), F.lit("M"), F.when(F.col("nm") % 2 == 0, "6S").otherwise("")))
    return reads(spark, sf_dir).withColumns(
        {"flag": flag.cast("int"), "cigar": cigar, "mate_cigar": mate_cigar, "mate_contig": F.when(F.col("okey") % 7 == 0, "X").otherwise(F.col("contig")), "isize": (F.col("s") - 1200) * 100, "mate_mapq": F.col("nm")}
    )


ALIGNMENTS = """alignments as (
  select *, cast(1 + case when qty % 2 = 0 then 2 else 0 end + case when mapq = 0 then 4 else 0 end + case when nm = 8 then 8 else 0 end + case when strand = 'F' then 16 else 0 end
      + case when ln % 2 = 0 then 32 else 0 end + case when ln % 2 = 1 then 64 else 128 end + case when qty >= 48 then 256 else 0 end + case when qty = 1 then 2048 else 0 end as integer) as flag,
    case when qty % 5 = 0 then qty || 'S' else '' end || (ln * 10 + 20) || 'M' || case when mapq % 3 = 0 then '2D5M' when mapq % 3 = 1 then '3I7M' else '' end || case when nm % 4 = 1 then (nm + 12) || 'S' else '' end as cigar,
    case when nm % 3 = 0 then null else case when ln % 3 = 0 then '4S' else '' end || (qty + 30) || 'M' || case when nm % 2 = 0 then '6S' else '' end end as mate_cigar,
    case when okey % 7 = 0 then 'X' else contig end as mate_contig, (s - 1200) * 100 as isize, nm as mate_mapq
  from reads)"""


def dna(text: F.Column) -> F.Column:
    """Latin letters as bases."""
    return F.translate(F.lower(F.regexp_replace(text, "[^a-zA-Z]", "")), _DNA_FROM, _DNA_TO)


def dna_sql(text: str) -> str:
    return f"translate(lower(regexp_replace({text}, '[^a-zA-Z]', '', 'g')), '{_DNA_FROM}', '{_DNA_TO}')"


def digits_dna(text: F.Column) -> F.Column:
    return F.translate(text.cast("string"), "0123456789", "ACGTAACAGT")


def digits_dna_sql(text: str) -> str:
    return f"translate(cast({text} as varchar), '0123456789', 'ACGTAACAGT')"
