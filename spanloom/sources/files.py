"""Written results: variant files, routed and sorted reads, statistics, diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_vcf(lines: DataFrame, header: list[str], path: str, contigs: list[str], passed_only: bool = False) -> None:
    """lines: contig, start, id, line and filter. A folder whose gzip parts, in order of their names, are one variant file: the
    header, then records by contig (in the order given), start and id as text. Parts are cut by range, so no task writes all."""
    spark = lines.sparkSession
    kept = lines.where(F.array_contains("filter", "PASS")) if passed_only else lines
    order = spark.createDataFrame([(c, i) for i, c in enumerate(contigs)], "contig string, ord int")
    rows = kept.join(F.broadcast(order), "contig").select("ord", "start", "id", "line")  # a row for each contig
    top = spark.createDataFrame([(-1, i, "", h) for i, h in enumerate(header)], "ord int, start long, id string, line string")
    top.unionByName(rows).orderBy("ord", "start", "id").select("line").write.mode("overwrite").option("compression", "gzip").text(path)


def write_routes(reads: DataFrame, route: str, path: str) -> None:
    """Reads by route (a column; null goes nowhere) and contig, sorted by position within each part; a folder is made only for what
    has rows. A contig is cut into ranges of positions, so that no task writes a whole one."""
    parts = int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = reads.where(F.col(route).isNotNull()).repartitionByRange(parts, route, "contig", "pos").sortWithinPartitions(route, "contig", "pos")
    sorted_.write.mode("overwrite").partitionBy(route, "contig").parquet(path)


def write_stats(stats: DataFrame, path: str) -> None:
    """stats: name, contig, value. Lines of the three, those of all contigs (`.`) first."""
    line = F.concat_ws(" ", "name", "contig", F.col("value").cast("string"))
    stats.orderBy((F.col("contig") != ".").cast("int"), "contig", "name").select(line).write.mode("overwrite").text(path)


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """name, contig, value of lines of three words; other lines are left out."""
    part = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.size(part) == 3).select(part[0].alias("name"), part[1].alias("contig"), part[2].try_cast("long").alias("value"))


def write_by_status(results: DataFrame, path: str) -> None:
    """results: status and line. The lines of each status in a folder of its own: what became of every assembly."""
    results.select("status", "line").write.mode("overwrite").partitionBy("status").text(path)
