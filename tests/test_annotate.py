"""Evidence around calls, the discordant joins, and clustering of a stream, on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from spanloom.operators import annotate
from spanloom.streaming.clusters import stream_clusters

READS = "file_ord long, qname string, flag int, contig string, pos long, mapq int, cigar string, mate_contig string, mate_pos long, isize long, seq string, qual string, mc string, mq int, nm int"


@pytest.fixture(scope="module")
def reads(spark):
    rows = [
        (1, "p", 99, "c", 100, 60, "10M", "c", 200, 110, "A" * 10, "I" * 10, "10M", 60, 0),
        (2, "p", 147, "c", 200, 60, "10M", "c", 100, -110, "A" * 10, "I" * 10, "10M", 60, 0),
        (3, "lone", 99, "c", 100, 60, "10M", "c", 200, 110, "A" * 10, "I" * 10, "10M", 60, 0),
        (4, "d", 65, "c", 300, 60, "10M", "x", 5, 0, "C" * 10, "I" * 10, "10M", 10, 1),
        (5, "d", 129 | 16, "x", 5, 10, "10M", "c", 300, 0, "ACGTTTTTTT", "ABCDEFGHIJ", "10M", 60, 0),
    ]
    return spark.createDataFrame(rows, READS)


def test_spanning_and_depth(spark, reads):
    calls = spark.createDataFrame([("i", "c", 150, 206, "98-112", "195-300")], "id string, contig string, start long, end long, left_anchor string, right_anchor string")
    r = annotate.flank_depths(annotate.spanning_counts(calls, reads, 10), reads).first()
    assert (r["left_spanning"], r["right_spanning"], r["left_depth"], r["right_depth"]) == (1, 0, 2, 1)


def test_mates_are_found_as_they_were_read(spark, reads):
    (r,) = annotate.stable_with_mates(reads, 20, 15).collect()
    assert (r["qname"], r["side"], r["mate_contig"], r["mate_seq"], r["mate_qual"]) == ("d", "R", "x", "AAAAAAACGT", "JIHGFEDCBA")


def test_clusters_take_pairs_and_match(spark):
    clusters = "id long, contig string, side string, start long, end long, members long"
    right = spark.createDataFrame([(1, "c", "R", 50, 100, 9), (2, "c", "R", 60, 110, 3)], clusters)
    left = spark.createDataFrame([(7, "c", "L", 120, 160, 5), (8, "c", "L", 130, 170, 2)], clusters)
    pairs = spark.createDataFrame([("c", "q", 80, 95), ("c", "far", 300, 320)], "contig string, qname string, mate_start long, mate_end long")
    assert [(r["cluster"], r["qname"]) for r in annotate.semi_mapped(right, pairs, 60).collect()] == [(1, "q")]
    assert [(r["r"], r["l"]) for r in annotate.matched_clusters(right, left, 50).collect()] == [(1, 7)]


def test_stream(spark, tmp_path):
    rows = [("a", p, f"2024-01-01 00:{p:02d}:00") for p in (0, 2, 5, 9, 11, 30)] + [("b", 50, "2024-01-01 00:50:00"), ("z", 59, "2024-01-01 02:00:00")]
    df = spark.createDataFrame(rows, "k string, p long, t string").withColumn("t", F.to_timestamp("t"))
    df.write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = stream_clusters(events, "k", "p", "t", 5).writeStream.format("memory").queryName("found").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    found = sorted((r["key"], r["anchor"], r["last"], r["members"]) for r in spark.table("found").collect())
    assert found[:3] == [("a", 0, 5, 3), ("a", 9, 11, 2), ("a", 30, 30, 1)] and ("b", 50, 50, 1) in found
