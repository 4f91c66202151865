"""Clusters and matchings that bins settle in rounds, against the same rules over everything at once."""

import random

from spanloom.operators import clustering, rounds


def parts(spans, roots):
    out = {}
    for s, r in zip(spans, roots, strict=True):
        out.setdefault(r, []).append(s)
    return sorted(out.values())


def test_bins_of_clusters_settle_what_the_whole_would():
    """Rounds over shifted bins, without Spark, on dense keys that have no gap."""
    for seed in range(60):
        draw = random.Random(seed)
        most = draw.choice([7, 20, 45])
        spans = sorted({(s := draw.randint(-300, 900), s + draw.randint(0, 25)) for _ in range(draw.choice([60, 300]))})
        left, done, turn, width = {s: (*s, s[1], False) for s in spans}, {}, 0, 8 * most
        while left:
            shift = width // 2 * (turn % 2)
            bins = {}
            for s, c in left.items():
                bins.setdefault((c[0] + shift) // width, {}).setdefault(c, []).append(s)
            before, left = len(left), {}
            for b, held in bins.items():
                order = sorted(held, key=lambda c: c[:2])
                roots, box, settled = clustering.agglomerate_part([(c[0], c[2], c[3]) for c in order], most, b * width - shift, (b + 1) * width - shift)
                for i, c in enumerate(order):
                    to = order[roots[i]]
                    new = (to[0], to[1], box[roots[i]][1], to[3] or roots.count(roots[i]) > 1)
                    for s in held[c]:
                        (done if settled[i] else left)[s] = new
            turn += 1
            assert turn < 200 and (len(left) <= before)
        assert parts(spans, [done[s][:2] for s in spans]) == parts(spans, clustering.agglomerate(spans, most))


def test_a_dense_key_is_clustered_over_several_bins(spark, monkeypatch):
    monkeypatch.setattr(rounds, "WIDTH", 8)
    draw = random.Random(2)
    spans = sorted({(s := draw.randint(0, 3_000), s + draw.randint(1, 30)) for _ in range(1_500)})
    rows = [(k, *s) for s in spans for k in ("x", "y") if k == "x" or s[0] % 3]
    found = clustering.agglomerative_clusters(spark.createDataFrame(rows, "k string, s long, e long"), ["k"], "s", "e", 60).collect()
    assert len(found) == len(rows)
    for k in "xy":
        mine = sorted((r["s"], r["e"], (r["island"], r["cluster"])) for r in found if r["k"] == k)
        own = [m[:2] for m in mine]
        assert parts(own, [m[2] for m in mine]) == parts(own, clustering.agglomerate(own, 60))
        assert all(r["cluster_start"] <= r["s"] and r["e"] <= r["cluster_end"] <= r["cluster_start"] + 60 for r in found)


def test_a_dense_key_is_matched_over_several_bins(spark, monkeypatch):
    monkeypatch.setattr(rounds, "WIDTH", 8)
    for seed in range(3):
        draw = random.Random(seed)
        # chains: each pair competes with its neighbours, and weights that rise along the key hand decisions on from bin to bin
        rows = [("x", a, b, a // 3 if seed == 0 else draw.randint(1, 6), 5 * a) for a in range(400) for b in {a + draw.randint(0, 3) for _ in range(3)}]
        found = clustering.greedy_matching(spark.createDataFrame(rows, "k string, a long, b long, w long, at long"), ["k"], "a", "b", "w", "at", 20)
        assert sorted((r["a"], r["b"]) for r in found.collect()) == sorted(clustering.greedy_pairs((w, a, b) for _, a, b, w, _ in rows))


def test_no_rows_and_rows_without_a_place(spark):
    kinds = "k string, a long, b long, w long, at long"
    assert clustering.greedy_matching(spark.createDataFrame([], kinds), ["k"], "a", "b", "w", "at", 5).count() == 0
    assert clustering.greedy_matching(spark.createDataFrame([("x", 1, 2, 3, None), (None, 4, 5, 6, 7)], kinds), ["k"], "a", "b", "w", "at", 5).collect() == [(None, 4, 5)]
    assert clustering.agglomerative_clusters(spark.createDataFrame([], "k string, s long, e long"), ["k"], "s", "e", 5).count() == 0


def plain_clusters(spans, most, clipped, left, slack):
    """The rule by trying all pairs again and again: the first pairs by what their union spans, later ones by twice that."""
    state = {i: (*s, c, False) for i, (s, c) in enumerate(zip(spans, clipped, strict=True))}
    root = list(range(len(spans)))
    while True:
        best = None
        for i in state:
            for j in state:
                a, b = state[i], state[j]
                span = max(a[1], b[1]) - min(a[0], b[0])
                over = (lambda x, y: x[0] > y[0] + slack) if left else (lambda x, y: x[1] < y[1] - slack)
                if i < j and span <= most and not (a[2] and over(a, b)) and not (b[2] and over(b, a)):
                    best = min(best or (10**9,), ((2 if a[3] or b[3] else 1) * span, i, j))
        if best is None:
            return root
        _, i, j = best
        a, b = state[i], state.pop(j)
        state[i] = (min(a[0], b[0]), max(a[1], b[1]), a[2] or b[2], True)
        root = [i if r == j else r for r in root]


def test_clipped_ends_hold_while_clusters_merge(spark, monkeypatch):
    changed = 0
    for seed in range(40):
        draw = random.Random(seed)
        left, most = bool(seed % 2), draw.choice([30, 60])
        spans = sorted({(s := draw.randint(0, 200), s + draw.randint(0, 20)) for _ in range(25)})
        clipped = [draw.random() < 0.3 for _ in spans]
        found = clustering.agglomerate(spans, most, clipped, left, 3)
        assert parts(spans, found) == parts(spans, plain_clusters(spans, most, clipped, left, 3))
        changed += parts(spans, found) != parts(spans, clustering.agglomerate(spans, most))
    assert changed > 10
    monkeypatch.setattr(rounds, "WIDTH", 8)
    draw = random.Random(4)
    spans = sorted({(s := draw.randint(0, 3_000), s + draw.randint(1, 30)) for _ in range(1_200)})
    clips = [draw.choice([0, 0, 0, 2, None]) for _ in spans]
    rows = [(side, *s, c) for s, c in zip(spans, clips, strict=True) for side in "LR"]
    found = clustering.agglomerative_clusters(spark.createDataFrame(rows, "side string, s long, e long, c long"), ["side"], "s", "e", 60, clips="c", side="side").collect()
    assert len(found) == len(rows)
    for side in "LR":
        mine = sorted((r["s"], r["e"], (r["island"], r["cluster"])) for r in found if r["side"] == side)
        assert parts([m[:2] for m in mine], [m[2] for m in mine]) == parts(spans, clustering.agglomerate(spans, 60, [bool(c) for c in clips], side == "L"))
