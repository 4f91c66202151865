"""Queries on alignment files that the tables are written to and read back from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.plans.registry import alignments, query
from spanloom.shared import Scratch
from spanloom.sources.bam import read_bam, write_bam

#: Contigs of the lines as reads: a day is 1,000 positions, and the first is in 1992.
CONTIGS = [("R", 5_000_000), ("N", 5_000_000), ("A", 5_000_000), ("X", 5_000_000)]
#: Two that overlap, a short one, and one to a contig's end.
REGIONS = [("A", 500_000, 900_000), ("A", 850_000, 1_000_000), ("R", 600_000, 600_001), ("N", 2_300_000, None)]

_SPAN = "(ln * 10 + 20 + case when mapq % 3 <= 1 then 7 else 0 end)"
_RECORDS = f"""{{READS}}, {{ALIGNMENTS}}, records as (
  select rid as qname, flag, contig, (s + 1200) * 1000 as pos, cast(mapq as integer) as mapq, cigar, mate_contig, isize, mate_cigar as mc, cast(nm as integer) as nm, (s + 1200) * 1000 + {_SPAN} as stop
  from alignments)"""
_SHOWN = "qname, flag, contig, pos, mapq, cigar, mate_contig, isize, mc, nm"


def _written(spark: SparkSession, sf_dir: str) -> str:
    """The folder with the lines' records."""
    day = (F.col("s") + 1200) * 1000
    records = alignments(spark, sf_dir).select(
        F.col("rid").alias("qname"), "flag", "contig", day.alias("pos"), "mapq", "cigar", "mate_contig", "isize", F.col("mate_cigar").alias("mc"), F.col("nm").cast("int").alias("nm"),
    )
    path = Scratch(spark, "bam").path("lines")
    write_bam(records, path, CONTIGS)
    return path


@query(
    "bam_region_scan",
    f"""with {_RECORDS} select {_SHOWN} from records
  where contig = 'A' and pos < 1000000 and stop > 500000 or contig = 'R' and pos < 600001 and stop > 600000 or contig = 'N' and stop > 2300000""",
)
def bam_region_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines as records of sorted, indexed BAM files, of which those over some regions are read back by the index, each once."""
    return read_bam(spark, _written(spark, sf_dir), REGIONS).select(*_SHOWN.split(", "))


@query("bam_contig_filter", f"with {_RECORDS} select {_SHOWN} from records where contig = 'N' and pos >= 1000000 and pos < 1400000 and flag & 16 = 0")
def bam_contig_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files under a filter on contig and position, which the scan takes over."""
    near = (F.col("contig") == "N") & (F.col("pos") >= 1_000_000) & (F.col("pos") < 1_400_000)
    return read_bam(spark, _written(spark, sf_dir)).where(near & (F.col("flag").bitwiseAND(16) == 0)).select(*_SHOWN.split(", "))
