"""Sinks read back."""

import glob
import gzip

from pyspark.sql import functions as F

from spanloom.functions import alignments as A
from spanloom.sources import files


def test_variant_files_are_sorted_and_complete(spark, tmp_path):
    rows = [("b", 5, "A_INS_2", ["PASS"]), ("b", 5, "A_INS_10", ["SMALL"]), ("a", 9, "x", ["PASS"]), ("a", 1, "y", ["LOW_SCORE", "SMALL"]), ("zz", 1, "q", ["PASS"])]
    lines = spark.createDataFrame([(c, s, i, f"{c}-{s}-{i}", f) for c, s, i, f in rows], "contig string, start long, id string, line string, filter array<string>")

    def read(name):
        parts = sorted(glob.glob(f"{tmp_path}/{name}/part-*.gz"))
        return [x for p in parts for x in gzip.open(p, "rt").read().splitlines()]

    files.write_vcf(lines, ["##h", "#c"], str(tmp_path / "all"), ["b", "a"])
    files.write_vcf(lines, ["##h", "#c"], str(tmp_path / "pass"), ["b", "a"], passed_only=True)
    assert read("all") == ["##h", "#c", "b-5-A_INS_10", "b-5-A_INS_2", "a-1-y", "a-9-x"] and read("pass") == ["##h", "#c", "b-5-A_INS_2", "a-9-x"]


def test_routes_stats_and_status(spark, tmp_path):
    reads = spark.createDataFrame([("R", "c", p) for p in (5, 3, 9)] + [("L", "d", 1), (None, "d", 2)], "route string, contig string, pos long")
    files.write_routes(reads, "route", str(tmp_path / "routes"))
    back = spark.read.parquet(str(tmp_path / "routes")).where("route = 'R'")
    assert sorted(r["pos"] for r in back.collect()) == [3, 5, 9] and spark.read.parquet(str(tmp_path / "routes")).count() == 4
    stats = spark.createDataFrame([("min_depth", "c", 4), ("min_depth", ".", 7)], "name string, contig string, value long")
    files.write_stats(stats, str(tmp_path / "stats"))
    assert {tuple(r) for r in files.read_stats(spark, str(tmp_path / "stats")).collect()} == {("min_depth", "c", 4), ("min_depth", ".", 7)}
    files.write_by_status(spark.createDataFrame([("no_seq", "x"), ("succeeded", "y")], "status string, line string"), str(tmp_path / "status"))
    assert glob.glob(f"{tmp_path}/status/status=no_seq/*.txt") and spark.read.text(str(tmp_path / "status")).count() == 2


def test_offsets_count_indels_of_the_first_read(spark):
    rows = [(100, "10M3I40M", 110), (100, "10M4D40M", 130), (95, "5S20M2I30M", 125), (100, "50M", 100)]
    df = spark.createDataFrame(rows, "us long, cigar string, at long")
    found = [r["x"] for r in df.select(A.start_offset(F.col("us"), F.col("cigar"), F.col("at")).alias("x")).collect()]
    assert found[0] in (10, 13) and found[1:] == [26, 32, 0]


def test_noise_at_a_clip_is_forgiven(spark):
    low, high = "#" * 10, "I" * 40
    df = spark.createDataFrame([("17S33M", low + high), ("17S33M", "I" * 50), ("17S16M17S", low + "I" * 30 + low), ("33M17S", high + low), ("40S10M", "#" * 33 + "I" * 17)], "cigar string, q string")
    ok = A.accepts(F.col("cigar"), F.lit(0), F.lit(40), F.lit(7), 0.04, F.col("q"), 20)
    assert [r["x"] for r in df.select(ok.alias("x")).collect()] == [True, False, False, True, False]
