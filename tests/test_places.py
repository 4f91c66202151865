"""Joins and overlaps by distinct places and texts: very many rows at few places make no row for each pair."""

import random

import pytest

from spanloom.functions import align as A
from pyspark.sql import functions as F

from spanloom.operators import annotate, overlaps
from spanloom.operators.calls import filters
from spanloom.operators.clustering import greedy_pairs
from spanloom.operators.intervals import contained_counts
from spanloom.operators.overlaps import exact_overlaps, overlap_degrees
from spanloom.operators.placement import place, place_many


def test_reads_of_one_place_meet_windows_of_one_place_once(spark):
    reads = spark.range(500).selectExpr("'c' as c", "id % 2 + 4 as s", "id % 2 + 8 as e")
    windows = spark.range(300).selectExpr("id", "'c' as c", "cast(3 as bigint) as p", "cast(3 + id % 10 as bigint) as q")
    found = contained_counts(reads, windows, ["c"], "s", "e", "p", "q", 4).collect()
    assert sorted((r["s"], r["q"], r["n"]) for r in found) == [(4, q, 250) for q in range(8, 13)] + [(5, q, 250) for q in range(9, 13)]


def test_only_the_first_cluster_of_a_reach_and_one_row_of_a_place_are_joined(spark, monkeypatch):
    met, join = [], annotate.intervals_in_intervals
    monkeypatch.setattr(annotate, "intervals_in_intervals", lambda *a: met.append(join(*a)) or met[-1])
    clusters = spark.range(400).selectExpr("id", "'c' as contig", "'L' as side", "id % 2 as start", "id % 2 + 9 as end", "if(id = 399, null, id div 100) as members")
    pairs = spark.range(1000).selectExpr("'c' as contig", "id as qname", "cast(5 as bigint) as mate_start", "cast(8 as bigint) as mate_end")
    found = annotate.semi_mapped(clusters, pairs, 20)
    assert met[0].count() == 2
    assert {(r["cluster"], r["contig"]) for r in found.collect()} == {(300, "c")} and found.count() == 1000


def test_matching_meets_distinct_places_and_is_the_greedy_one(spark, monkeypatch):
    met, join = [], annotate.within_band
    monkeypatch.setattr(annotate, "within_band", lambda *a: met.append(join(*a)) or met[-1])
    right = spark.range(300).selectExpr("id", "'c' as contig", "id % 3 as start", "id % 3 + 5 as end", "id * 7 % 11 as members")
    left = spark.range(1000, 1300).selectExpr("id", "'c' as contig", "id % 3 as start", "id % 3 + 5 as end", "id * 5 % 13 as members")
    found = annotate.matched_clusters(right, left, 6)
    a, b = [r.asDict() for r in right.collect()], [r.asDict() for r in left.collect()]
    offers = [(x, min((y for y in b if abs(y["start"] - x["end"]) <= 6), key=lambda y: (-y["members"], y["start"], y["id"]))) for x in a]
    want = greedy_pairs([(x["members"] * y["members"], x["id"], y["id"]) for x, y in offers])
    assert sorted((r["r"], r["l"]) for r in found.collect()) == sorted(want)
    assert met[0].count() <= 9


def _sequences(spark):
    """Few letters and few texts, so that suffixes lie within one another, whole texts overlap and many are equal."""
    texts = ["".join("AC"[i >> k & 1] for k in range(n)) for n in range(3, 7) for i in range(0, 1 << n, 3)] + ["AAAAAA"] * 5 + ["AAAAA"] * 3
    return list(enumerate(texts)), spark.createDataFrame(list(enumerate(texts)), "i long, q string")


def test_overlaps_of_equal_texts_are_those_of_all_pairs(spark):
    rows, df = _sequences(spark)
    fits = lambda p, q: [k for k in range(3, min(len(p), len(q)) + 1) if p[-k:] == q[:k]]
    want = sorted((a, b, max(fits(p, q))) for a, p in rows for b, q in rows if a != b and fits(p, q))
    assert sorted(tuple(r) for r in exact_overlaps(df, "i", "q", 3).collect()) == want


def _shuffled(plan):
    """Rows that went through the exchanges of a plan that has run."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        return _shuffled(plan.executedPlan())
    if plan.nodeName().endswith("QueryStage"):
        return _shuffled(plan.plan())
    below = sum(_shuffled(plan.children().apply(k)) for k in range(plan.children().size()))
    return below + (plan.metrics().get("shuffleRecordsWritten").get().value() if plan.nodeName() == "Exchange" else 0)


def test_pairs_of_different_texts_with_equal_ends_are_not_shuffled(spark):
    middles = ["".join("ACGT"[k >> s & 3] for s in (0, 2, 4, 6)) for k in range(256)]
    texts = ["GGTGG" + m + "AAACC" for m in middles] + ["AAACC" + m + "TTCTT" for m in middles]
    found = exact_overlaps(spark.createDataFrame(list(enumerate(texts)), "i long, q string"), "i", "q", 5)
    want = [(a, b, k) for a, b, k in _all_pairs(list(enumerate(texts)), 5) if a != b]
    assert len(want) >= 256 * 256 and sorted(tuple(r) for r in found.collect()) == want
    assert _shuffled(found._jdf.queryExecution().executedPlan()) < len(want) / 2


def test_overlaps_in_blocks_and_pieces_are_those_of_all_pairs(spark, monkeypatch):
    rows, df = _sequences(spark)
    want = sorted(tuple(r) for r in exact_overlaps(df, "i", "q", 3).collect())
    for name, value in (("_BLOCK", 2), ("_PARTS", 3), ("_MOST", 4)):
        monkeypatch.setattr(overlaps, name, value)
    assert sorted(tuple(r) for r in exact_overlaps(df, "i", "q", 3).collect()) == want
    # ids that several sequences share, and none
    again = df.selectExpr("nullif(i % 40, 7) as i", "q")
    want = sorted((a % 40, b % 40, k) for a, b, k in _all_pairs(rows, 3) if 7 not in (a % 40, b % 40) and a % 40 != b % 40)
    assert sorted(tuple(r) for r in exact_overlaps(again, "i", "q", 3).collect()) == want


def _all_pairs(rows, least):
    for a, p in rows:
        for b, q in rows:
            if fit := [k for k in range(least, min(len(p), len(q)) + 1) if p[-k:] == q[:k]]:
                yield a, b, max(fit)


def test_blocks_of_ids_become_rows_in_pieces(spark):
    blocks = [(list(range(700)), list(range(300, 901)), 5), ([1, 2], list(range(1000, 1300)), 6), ([3], [4], 7), (list(range(256)), [5], 8)]
    df = spark.createDataFrame(blocks, "ids_a array<long>, ids_b array<long>, overlap int")
    pieces = df.mapInArrow(overlaps._pieces, df.schema).collect()
    assert max(max(len(r["ids_a"]), len(r["ids_b"])) for r in pieces) <= overlaps._PIECE
    assert sorted((a, b, r["overlap"]) for r in pieces for a in r["ids_a"] for b in r["ids_b"]) == sorted((a, b, k) for x, y, k in blocks for a in x for b in y)


def test_degrees_count_proper_overlaps_even_beside_whole_ones(spark):
    rows, df = _sequences(spark)
    fits = lambda p, q: [k for k in range(3, min(len(p), len(q))) if p[-k:] == q[:k]]
    edges = [(a, b, max(fits(p, q))) for a, p in rows for b, q in rows if a != b and fits(p, q)]
    want = sorted((a, sum(e[0] == a for e in edges), max(e[2] for e in edges if e[0] == a), min(e[1] for e in edges if e[0] == a)) for a in {e[0] for e in edges})
    assert sorted(tuple(r) for r in overlap_degrees(df, "i", "q", 3).select("source", "degree", "best", "first_target").collect()) == want


def _texts(seed):
    """Pieces of a reference with letters changed, left out and put in, and strangers."""
    r = random.Random(seed)
    dna = lambda n: "".join(r.choices("ACGTN", (8, 8, 8, 8, 1), k=n))
    for _ in range(150):
        ref = dna(r.randrange(90))
        a, b = sorted(r.randrange(len(ref) + 1) for _ in range(2))
        cut = r.randrange(a, b + 1)
        yield r.choice([ref[a:b], ref[a:cut] + dna(r.randrange(9)) + ref[cut + r.randrange(4) : b], dna(r.randrange(40))]), ref


@pytest.mark.parametrize("scoring", [A.DEFAULT, A.PERMISSIVE, A.TO_BASE, A.HARSH, A.Scoring(1, 100, 100, 100)])
def test_pairs_aligned_together_are_as_those_aligned_alone(scoring):
    pairs = list(_texts(7))
    assert A.align_many([q for q, _ in pairs], [r for _, r in pairs], scoring) == [A.align(q, r, scoring) for q, r in pairs]


def test_cases_placed_together_are_as_those_placed_alone():
    r = random.Random(3)
    dna = lambda n: "".join(r.choices("ACGT", k=n))
    cases, wholes = [], []
    for n in (60, 70, 90):
        ref, new = dna(150 + n), dna(n)
        whole = ref[:80] + new + ref[80:]
        cases += [([whole[10 : len(whole) - 10]], ref), ([whole[20:110], whole[len(whole) - 100 :]], ref), ([], ref), ([whole], "")]
        wholes.append(whole)
    found = place_many(cases)
    assert found == [place(*c) for c in cases]
    for k, whole in enumerate(wholes):
        (_, ref), call = cases[4 * k], found[4 * k]
        assert ref[: call.start + 1] + call.seq + ref[call.end + 1 :] == whole
        assert found[4 * k + 2] is None and found[4 * k + 3] is None


def test_depths_of_both_anchors_come_from_one_count(spark, monkeypatch):
    runs, median = [], annotate.median_covered
    monkeypatch.setattr(annotate, "median_covered", lambda *a: runs.append(0) or median(*a))
    calls = spark.createDataFrame([(1, "c", "0-4", "10-14"), (2, "c", "90-99", "12-13")], "id long, contig string, left_anchor string, right_anchor string")
    reads = spark.createDataFrame([("c", 0, "20M"), ("c", 2, "3S10M2D1I2M9S"), ("c", 3, None)], "contig string, pos long, cigar string")
    found = annotate.flank_depths(calls, reads, 16).orderBy("id").select("left_depth", "right_depth").collect()
    assert [tuple(r) for r in found] == [(1, 2), (0, 2)] and len(runs) == 1


def test_scores_of_one_cigar_are_worked_out_once(spark, sf_dir):
    from spanloom.plans.catalogue import QUERIES

    plan = QUERIES["prefix_score_arrays"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("array_max")  # below the join, on distinct CIGARs


def test_filters_need_no_lambda(spark):
    named = {"ONE": F.col("id") > 0, "TWO": F.col("id") > 1, "THREE": F.lit(None).cast("boolean")}
    df = spark.range(3).select(filters(named).alias("f"))
    assert [r["f"] for r in df.collect()] == [["PASS"], ["ONE"], ["ONE", "TWO"]]
    assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()
