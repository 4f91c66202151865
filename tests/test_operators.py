"""Operators against brute force on small random tables."""

import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import calls, clustering, consensus, coverage, intervals, overlaps, running, sampling


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def spans(spark):
    draw = random.Random(3)
    data = [(i, draw.choice("ab"), s := draw.randint(-50, 200), s + draw.randint(0, 40)) for i in range(120)]
    return data, table(spark, data, "i long, k string, s long, e long").cache()


@pytest.fixture(scope="module")
def places(spark):
    draw = random.Random(4)
    data = [(i, draw.choice("ab"), draw.randint(-60, 250)) for i in range(80)]
    return data, table(spark, data, "j long, k string, p long").cache()


@pytest.mark.parametrize("width", [1, 7, 64])
def test_points_in_intervals(spans, places, width):
    found = intervals.points_in_intervals(places[1], spans[1], ["k"], "p", "s", "e", width).select("j", "i").collect()
    assert sorted(map(tuple, found)) == sorted((j, i) for j, k, p in places[0] for i, k2, s, e in spans[0] if k == k2 and s <= p < e)


@pytest.mark.parametrize("width", [1, 7, 64])
def test_overlapping(spans, width):
    other = spans[1].select("k", F.col("i").alias("i2"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    found = intervals.overlapping(spans[1], other, ["k"], "s", "e", "s2", "e2", width).select("i", "i2").collect()
    assert sorted(map(tuple, found)) == sorted((a[0], b[0]) for a in spans[0] for b in spans[0] if a[1] == b[1] and a[2] < b[3] and b[2] < a[3] and a[3] > a[2] and b[3] > b[2])


@pytest.mark.parametrize("anti", [False, True])
def test_overlaps_any(spark, spans, anti):
    draw = random.Random(5)
    right = [(draw.choice("ab"), s := draw.randint(-50, 220), s + draw.randint(0, 6)) for _ in range(12)]
    df = table(spark, right, "k string, s2 long, e2 long")
    found = {r["i"] for r in intervals.overlaps_any(spans[1], df, ["k"], "s", "e", "s2", "e2", anti).collect()}
    hit = {i for i, k, s, e in spans[0] if any(k == k2 and s < e2 and s2 < e and e > s and e2 > s2 for k2, s2, e2 in right)}
    assert found == ({i for i, *_ in spans[0]} - hit if anti else hit)


def test_depth_and_empty(spark, spans, places):
    found = {r["j"]: r["depth"] for r in running.depth_at(places[1], spans[1], ["k"], "p", "s", "e").collect()}
    assert found == {j: sum(k == k2 and s <= p < e for _, k2, s, e in spans[0]) for j, k, p in places[0]}
    assert running.depth_at(places[1].limit(0), spans[1], ["k"], "p", "s", "e").count() == 0
    assert {r["depth"] for r in running.depth_at(places[1], spans[1].limit(0), ["k"], "p", "s", "e").collect()} == {0}


def test_order_statistics(spark):
    draw = random.Random(6)
    values = [draw.randint(0, 9000) for _ in range(501)] + [None]
    df = table(spark, [(v,) for v in values], "v long")
    r = running.order_statistics(df, [], "v", {"lo": F.expr("n div 100"), "mid": F.expr("n div 2"), "hi": F.expr("n + 7")}).first()
    have = sorted(v for v in values if v is not None)
    assert (r["n"], r["lo"], r["mid"], r["hi"]) == (501, have[5], have[250], have[-1])


def test_anchored_clusters(spark):
    draw = random.Random(7)
    data = [(i, draw.choice("ab"), draw.randint(0, 150)) for i in range(90)]
    found = {r["i"]: r["anchor"] for r in clustering.anchored_clusters(table(spark, data, "i long, k string, p long"), ["k"], "p", "i", 5).collect()}
    want, anchor = {}, {}
    for i, k, p in sorted(data, key=lambda r: (r[1], r[2], r[0])):
        if k not in anchor or p - anchor[k] > 5:
            anchor[k] = p
        want[i] = anchor[k]
    assert found == want


def test_agglomerative_islands_equal_the_whole(spark):
    draw = random.Random(8)
    data = sorted({(s := draw.randint(0, 900), s + draw.randint(1, 20)) for _ in range(60)})
    whole = clustering.agglomerate(data, 40)
    want = sorted((min(data[j][0] for j in range(len(data)) if whole[j] == whole[i]), max(data[j][1] for j in range(len(data)) if whole[j] == whole[i]), *data[i]) for i in range(len(data)))
    found = clustering.agglomerative_clusters(table(spark, [("x", *d) for d in data], "k string, s long, e long"), ["k"], "s", "e", 40)
    assert sorted((r["cluster_start"], r["cluster_end"], r["s"], r["e"]) for r in found.collect()) == want
    assert all(b - a <= 40 for a, b, *_ in want)


def test_greedy_matching_is_that_of_the_whole(spark):
    draw = random.Random(9)
    rows = sorted({(a := draw.randint(0, 40), b, (w := draw.randint(1, 9))) for b in range(100, 140) for _ in range(2)})
    data = [("k", a, b, w, a * 100 + b) for a, b, w in rows]
    found = clustering.greedy_matching(table(spark, data, "k string, a long, b long, w long, at long"), ["k"], "a", "b", "w", "at", 10_000)
    assert sorted((r["a"], r["b"]) for r in found.collect()) == sorted(clustering.greedy_pairs((w, a, b) for a, b, w in rows))


def test_sequential_ids_follow_the_order(spark):
    data = [(random.Random(i).random(), i) for i in range(200)]
    found = calls.sequential_ids(table(spark, data, "x double, i long"), ["x", "i"], "S_").collect()
    assert {r["i"]: r["id"] for r in found} == {i: f"S_{n}" for n, (_, i) in enumerate(sorted(data))}


def test_covered_ends(spark):
    data = [("a", 0, 5, 0, 30), ("a", 4, 9, 0, 30), ("a", 12, 20, 0, 30), ("a", 25, 30, 0, 30), ("b", 3, 9, 0, 10), ("c", 0, 10, 0, 10)]
    found = calls.covered_ends(table(spark, data, "k string, s long, e long, lo long, hi long"), ["k"], "s", "e", "lo", "hi").collect()
    assert {r["k"]: (r["prefix"], r["suffix"]) for r in found} == {"a": (9, 5), "b": (0, 0), "c": (10, 10)}


def test_median_covered(spark, spans):
    targets = [(n, "ab"[n % 2], 10 * n, 10 * n + 15) for n in range(-6, 24)]
    df = table(spark, targets, "t long, k string, lo long, hi long")
    found = {r["t"]: (r["covered"], r["median"]) for r in coverage.median_covered(df, spans[1], ["k"], ["t"], "lo", "hi", "s", "e", 16).collect()}
    for t, k, lo, hi in targets:
        depth = sorted((sum(k == k2 and s <= q < e for _, k2, s, e in spans[0]) for q in range(lo, hi)), reverse=True)
        n = sum(d > 0 for d in depth)
        assert found[t] == (n, depth[n // 2] if n else 0) or (n and found[t][0] == n and depth[n // 2] == found[t][1])


def test_filters_and_support(spark):
    df = table(spark, [(1, 5, 0), (2, 0, 0)], "i long, pos long, neg long")
    total, score = calls.support([F.col("pos")], F.col("neg"))
    r = df.select("i", total.alias("t"), score.alias("s"), calls.filters({"A": F.col("pos") > 1, "B": F.col("pos") / F.nullif(F.col("neg"), F.lit(0)) > 1}).alias("f")).orderBy("i").collect()
    assert [(x["t"], x["s"], x["f"]) for x in r] == [(5, 1.0, ["A"]), (0, None, ["PASS"])]


def test_exact_overlaps(spark):
    seqs = {1: "AACCGGT", 2: "GGTAAC", 3: "ACCA", 4: ""}
    found = {(r["a"], r["b"]): r["overlap"] for r in overlaps.exact_overlaps(table(spark, list(seqs.items()), "i long, q string"), "i", "q", 2).collect()}
    want = {}
    for a, x in seqs.items():
        for b, y in seqs.items():
            best = max((k for k in range(2, min(len(x), len(y)) + 1) if x.endswith(y[:k])), default=0)
            if a != b and best:
                want[a, b] = best
    assert found == want


def test_vote_breaks_ties():
    assert consensus.vote(["AC", "AG"], ["!!", "!!"], [0, 0]) == "AC"
    assert consensus.vote(["AC", "AG"], ["!!", "!5"], [0, 0]) == "AG"
    assert consensus.vote(["T", "T"], [None, None], [0, 2]) == "TAT"


def test_random_positions_are_reproducible():
    regions = sampling.whole_contigs({"x": 50_000, "y": 20_000, "tiny": 1500})
    drawn = sampling.random_positions(regions, 0)
    assert drawn == sampling.random_positions(regions, 0) and len(drawn) == 65
    assert all(1000 <= p < (49_000 if c == "x" else 19_000) for c, p in drawn)
