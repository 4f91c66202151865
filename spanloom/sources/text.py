"""Reference sequences, regions and variants from text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions.vcf import info_map

#: Bases for each chunk of a reference sequence.
CHUNK = 65_536


#: Long lines are cut into pieces of so many letters before they are dealt to chunks.
_PIECE = 8192


def read_fasta(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """contig, chunk_id, chunk: sequences with their case, cut into chunks, so that no cell holds a whole chromosome.

    Lines are keyed by file, start of the split and order within it, as Spark does not read splits in file order. A line belongs
    to the last header before it in its split, or, where there is none, to the last one of the splits before it in its file;
    only one row for each split crosses splits. A name that stands in several places goes on where it left off."""
    place = ["file", "block"]
    name = F.split_part(F.substring("line", 2, 1 << 20), F.lit(" "), F.lit(1))
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.trim("value").alias("line"))
    lines = lines.where("line <> ''").withColumn("head", F.col("line").startswith(">"))
    inside = Window.partitionBy(*place).orderBy("at")
    runs = lines.withColumns({"run": F.sum(F.col("head").cast("long")).over(inside), "own": F.last(F.when(F.col("head"), name), ignorenulls=True).over(inside)})
    runs = runs.where("not head").withColumn("n", F.length("line").cast("long"))
    runs = runs.withColumn("upto", F.sum("n").over(Window.partitionBy(*place, "run").orderBy("at")))
    # one row for each run of a split: its name and length; headers without sequence count as well
    headed = lines.where("head").groupBy(*place).agg(F.count("*").alias("heads"), F.max_by(name, "at").alias("last"))
    sizes = runs.groupBy(*place, "run").agg(F.max("upto").alias("size"), F.first("own").alias("own"))
    along = Window.partitionBy("file").orderBy("block")
    splits = sizes.select(*place).unionByName(headed.select(*place)).distinct().join(headed, place, "left")
    splits = splits.withColumn("carried", F.last("last", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))).select(*place, "carried")
    named = sizes.join(splits, place).withColumn("contig", F.coalesce("own", "carried")).where("contig is not null")
    before = Window.partitionBy("contig").orderBy("file", "block", "run").rowsBetween(Window.unboundedPreceding, -1)
    named = named.withColumn("base", F.coalesce(F.sum("size").over(before), F.lit(0))).select(*place, "run", "contig", "base")
    laid = runs.join(named, [*place, "run"]).select("contig", (F.col("base") + F.col("upto") - F.col("n")).alias("start"), "line")
    pieces = laid.select("contig", "start", F.posexplode(F.regexp_extract_all("line", F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))).alias("k", "s"))
    pieces = pieces.select("contig", (F.col("start") + F.col("k") * _PIECE).alias("start"), "s").withColumn("end", F.col("start") + F.length("s"))
    parts = pieces.select("contig", "start", "end", "s", F.explode(F.sequence(F.expr(f"start div {chunk}"), F.expr(f"(end - 1) div {chunk}"))).alias("chunk_id"))
    low, high = F.greatest(F.col("start"), F.col("chunk_id") * chunk), F.least(F.col("end"), (F.col("chunk_id") + 1) * chunk)
    piece = F.col("s").substr((low - F.col("start") + 1).cast("int"), (high - low).cast("int"))
    grouped = parts.select("contig", "chunk_id", F.struct(low.alias("at"), piece.alias("s")).alias("p")).groupBy("contig", "chunk_id")
    return grouped.agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["s"]), "").alias("chunk"))


def contig_lengths(reference: DataFrame) -> DataFrame:
    return reference.groupBy("contig").agg(F.sum(F.length("chunk")).alias("length"))


def read_regions(spark: SparkSession, path: str, lengths: DataFrame, margin: int = 1000) -> DataFrame:
    """contig, start, end: lines of three or more columns as they are, of one column the whole contig but for a margin."""
    f = F.split("value", "\t")
    given = spark.read.text(path).where(F.trim("value") != "").select(f[0].alias("contig"), F.get(f, F.lit(1)).try_cast("long").alias("start"), F.get(f, F.lit(2)).try_cast("long").alias("end"))
    whole = given.join(lengths, "contig", "left")
    return whole.select("contig", F.coalesce("start", F.lit(margin)).alias("start"), F.coalesce("end", F.col("length") - margin).alias("end"))


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """contig, pos (0-based), id, ref, alt, filter (array), info (map)."""
    f = lambda i: F.get(F.split("value", "\t"), F.lit(i))  # noqa: E731  tolerant, as the optimiser may look at header lines too
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    return lines.select(f(0).alias("contig"), (f(1).try_cast("long") - 1).alias("pos"), f(2).alias("id"), f(3).alias("ref"), f(4).alias("alt"), F.split(f(6), ";").alias("filter"), info_map(f(7)).alias("info"))
