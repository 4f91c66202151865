"""Alignment records from SAM text; BAM files have the same columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.sources.bam import COLUMNS, BamDataSource, read_bam, write_bam  # noqa: F401


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """SAM text; Spark splits large files. Positions are 0-based; `*` becomes null. file_ord is the place of the line in its
    split after the split's number, so it orders the lines of a file as they stand."""
    lines = spark.read.text(path).withColumns({"file": F.input_file_name(), "file_ord": F.monotonically_increasing_id()}).where(~F.col("value").startswith("@"))
    f = lambda i: F.get(F.split("value", "\t"), F.lit(i))  # noqa: E731  tolerant, as the optimiser may look at header lines too
    tag = lambda name: F.nullif(F.regexp_extract("value", f"\t{name}:[A-Za-z]:([^\t]*)", 1), F.lit(""))
    none = lambda c: F.when(c != "*", c)
    contig = none(f(2))
    return lines.select(
        "file", "file_ord", f(0).alias("qname"), f(1).try_cast("int").alias("flag"), contig.alias("contig"), (f(3).try_cast("long") - 1).alias("pos"), f(4).try_cast("int").alias("mapq"), none(f(5)).alias("cigar"),
        F.when(f(6) == "=", contig).otherwise(none(f(6))).alias("mate_contig"), (f(7).try_cast("long") - 1).alias("mate_pos"), f(8).try_cast("long").alias("isize"), none(f(9)).alias("seq"), none(f(10)).alias("qual"),
        tag("MC").alias("mc"), tag("MQ").try_cast("int").alias("mq"), tag("NM").try_cast("int").alias("nm"), tag("MD").alias("md"),
    )
