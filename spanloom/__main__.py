"""python -m spanloom READS REFERENCE FOLDER: small insertions of an alignment file (BAM, or SAM as text), as variant files.

FOLDER/all.vcf and FOLDER/pass.vcf are folders whose gzip parts, in order, make up a file each."""

from __future__ import annotations

import argparse
import sys
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from spanloom.operators.sampling import head_max
from spanloom.plans.config import Config
from spanloom.plans.insertions import call_small_insertions
from spanloom.session import ship
from spanloom.sources import bam, sam
from spanloom.sources.files import write_vcf
from spanloom.sources.text import contig_lengths, read_fasta


def main(args: list[str], spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="spanloom", description="Calls small insertions.")
    parser.add_argument("reads")
    parser.add_argument("reference")
    parser.add_argument("folder")
    for name, kind in (("min-insertion-size", int), ("min-clip-len", int), ("max-clipped-pos-dist", int), ("max-seq-error", float)):
        parser.add_argument(f"--{name}", type=kind)
    parser.add_argument("--seed", type=int, default=0)
    parser.add_argument("--sample", default="1")
    given = parser.parse_args(args)
    spark = ship(spark or SparkSession.builder.appName("spanloom").getOrCreate())
    if given.reads.endswith(".bam"):
        reads = bam.read_bam(spark, given.reads)
    else:
        reads = sam.read_sam(spark, given.reads)
    reference = read_fasta(spark, given.reference)
    chosen = {k: v for k in ("min_insertion_size", "min_clip_len", "max_clipped_pos_dist", "max_seq_error") if (v := getattr(given, k)) is not None}
    longest = head_max(reads, ["file_ord"], F.length("seq")).first()["most"]
    config = replace(Config(), **chosen, **({"read_len": longest} if longest else {}))
    lines, header = call_small_insertions(reads, reference, config, given.seed, given.sample, " ".join(["spanloom", *args]))
    lines = lines.persist()
    contigs = [r["contig"] for r in contig_lengths(reference).orderBy("contig").collect()]  # a row for each contig
    for name, passed in (("all", False), ("pass", True)):
        write_vcf(lines, header, f"{given.folder.rstrip('/')}/{name}.vcf", contigs, passed)
    lines.unpersist()


if __name__ == "__main__":
    main(sys.argv[1:])
