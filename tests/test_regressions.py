"""Cases that went wrong on data that is not tiny."""

import math
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from spanloom.operators import clustering, consensus
from spanloom.operators.calls import sequential_ids
from spanloom.operators.sampling import default_lookup
from spanloom.sources.text import read_fasta


def test_sequential_ids_of_a_million_rows_with_a_payload(spark):
    rows = spark.range(0, 1_000_000, 1, 8).select(F.xxhash64("id").alias("k"), "id", F.repeat(F.col("id").cast("string"), 4).alias("payload"))
    found = sequential_ids(rows.withColumnRenamed("id", "n"), ["k", "n"], "x").select(F.substring("id", 2, 20).cast("long").alias("i"), "k")
    got = found.agg(F.count_distinct("i").alias("d"), F.min("i").alias("lo"), F.max("i").alias("hi")).first()
    assert tuple(got) == (1_000_000, 0, 999_999)
    ends = found.where("i in (0, 999999)").orderBy("i").collect()
    bounds = rows.agg(F.min("k"), F.max("k")).first()
    assert [r["k"] for r in ends] == list(bounds)


def test_fasta_of_several_files_and_splits(spark, tmp_path):
    draw, want = random.Random(1), {}
    for f, sizes in {"b": {"c1": 150_000, "c2": 10}, "a": {"d1": 0, "d2": 180_000}}.items():
        with open(tmp_path / f"{f}.fa", "w") as out:
            for c, n in sizes.items():
                want[c] = "".join(draw.choices("ACGTacgtN", k=n))
                out.write(f">{c} text\n" + "".join(want[c][i : i + 60] + "\n" for i in range(0, n, 60)) + "\n")
    with open(tmp_path / "one.fa", "w") as out:
        want["e1"] = "".join(draw.choices("ACGT", k=100_001))
        out.write(">e1\n" + want["e1"])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = read_fasta(spark, str(tmp_path), 4096).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    found = {}
    for r in sorted(rows, key=lambda r: (r["contig"], r["chunk_id"])):
        found[r["contig"]] = found.get(r["contig"], "") + r["chunk"]
    assert found == {c: s for c, s in want.items() if s}


def test_default_lookup_without_a_default(spark):
    stats = spark.createDataFrame([("a", 5)], "contig string, value long")
    wanted = spark.createDataFrame([("a",), ("b",)], "contig string")
    assert {tuple(r) for r in default_lookup(stats, wanted, "contig").collect()} == {("a", 5), ("b", None)}
    with_default = stats.unionByName(spark.createDataFrame([(".", 7)], stats.schema))
    assert {tuple(r) for r in default_lookup(with_default, wanted, "contig").collect()} == {("a", 5), ("b", 7)}


def test_anchored_clusters_of_a_dense_contig(spark):
    """A million places without a gap, over several bins."""
    rows = spark.range(0, 1_000_000, 1, 4).select(F.lit("c").alias("k"), (F.col("id") - 300_000).alias("p"), "id")
    found = clustering.anchored_clusters(rows, ["k"], "p", "id", 240)
    wrong = found.where(F.col("anchor") != F.col("p") - F.pmod(F.col("p") + 300_000, F.lit(241))).count()
    assert (found.count(), wrong) == (1_000_000, 0)


def test_anchored_clusters_over_small_bins(spark, monkeypatch):
    monkeypatch.setattr(clustering, "_ANCHOR_BIN", 1)
    draw = random.Random(11)
    data = [(draw.choice(["a", "b", None]), draw.choice([draw.randint(-900, 2000), draw.randint(0, 40_000)]), i) for i in range(1500)]
    for distance in (0, 3, 40):
        found = {r["i"]: r["anchor"] for r in clustering.anchored_clusters(spark.createDataFrame(data, "k string, p long, i long"), ["k"], "p", "i", distance).collect()}
        want, anchor = {}, {}
        for k, p, i in sorted(data, key=lambda r: (str(r[0]), r[1])):
            if k not in anchor or p - anchor[k] > distance:
                anchor[k] = p
            want[i] = anchor[k]
        assert found == want


def test_islands_are_numbered_along_a_key(spark):
    draw = random.Random(12)
    data = [(draw.choice("ab"), draw.randint(0, 60_000)) for _ in range(900)]
    found = {(r["k"], r["p"]): r["island"] for r in clustering.islands(spark.createDataFrame(data, "k string, p long"), ["k"], "p", 70).collect()}
    want = {}
    for k in "ab":
        places, n = sorted({p for x, p in data if x == k}), 0
        for i, p in enumerate(places):
            n += i == 0 or p - places[i - 1] > 70
            want[k, p] = n
    assert found == want


def _merge_nearest(spans, most):
    """Clusters by the rule as it is stated: among all pairs the one that spans least is merged, as long as it spans at most `most`.
    Pairs of first intervals count with their span, pairs that a merge made with twice theirs; of equals those of the earlier."""
    clusters = {i: (s, e, 0) for i, (s, e) in enumerate(spans)}
    members, fresh = {i: [i] for i in clusters}, set()
    while True:
        pairs = []
        for i in clusters:
            for j in clusters:
                if i < j:
                    span = max(clusters[i][1], clusters[j][1]) - min(clusters[i][0], clusters[j][0])
                    if span <= most:
                        pairs.append(((2 if i in fresh or j in fresh else 1) * span, i, j))
        if not pairs:
            return sorted(sorted(spans[x] for x in m) for m in members.values())
        _, i, j = min(pairs)
        clusters[i] = (min(clusters[i][0], clusters[j][0]), max(clusters[i][1], clusters[j][1]), 0)
        members[i] += members.pop(j)
        del clusters[j]
        fresh.add(i)


def test_agglomerative_clusters_equal_the_stated_rule(spark):
    for seed in range(25):
        draw = random.Random(seed)
        spans = sorted({(s := draw.randint(0, 400), s + draw.randint(1, 20)) for _ in range(40)})
        found = clustering.agglomerative_clusters(spark.createDataFrame([("x", *d) for d in spans], "k string, s long, e long"), ["k"], "s", "e", 45) if seed < 2 else None
        groups = {}
        for i, root in enumerate(clustering.agglomerate(spans, 45)):
            groups.setdefault(root, []).append(spans[i])
        assert sorted(sorted(g) for g in groups.values()) == _merge_nearest(spans, 45)
        if found is not None:
            got = {}
            for r in found.collect():
                got.setdefault((r["island"], r["cluster"]), []).append((r["s"], r["e"]))
            assert sorted(sorted(g) for g in got.values()) == _merge_nearest(spans, 45)


def test_greedy_matching_equals_the_stated_rule(spark):
    """The heaviest candidate whose sides are both free is taken, again and again."""
    draw = random.Random(13)
    rows = [("k", a, b, draw.randint(1, 9), 50 * (a // 4)) for a in range(40) for b in {100 + a // 4 * 10 + draw.randint(0, 6) for _ in range(3)}]
    left, want = [(w, a, b) for _, a, b, w, _ in rows], []
    while left:
        w, a, b = max(left, key=lambda r: (r[0], -r[1], -r[2]))
        want.append((a, b))
        left = [r for r in left if r[1] != a and r[2] != b]
    found = clustering.greedy_matching(spark.createDataFrame(rows, "k string, a long, b long, w long, at long"), ["k"], "a", "b", "w", "at", 10)
    assert sorted((r["a"], r["b"]) for r in found.collect()) == sorted(want)


def test_reads_meet_the_consensus_of_their_columns_whole(spark):
    """Mismatches by stretches of columns are those by columns, across stretches, gaps, other letters and equal ids; no letter of a
    read but its vote is a row."""
    draw, rows = random.Random(4), []
    for c in ("a", "b", None):
        for i in range(9):
            n = draw.choice([1, 30, 700])
            rows.append((c, i % 7, "".join(draw.choices("ACGTacgtN", k=n)), draw.choice([0, 3, 500, 511, 512, 1500]), "".join(draw.choices("!5I", k=n))))
    rows += [("a", 20, "", 0, ""), ("a", 21, None, 0, None), ("n", 22, "NNN", 0, "III"), ("a", 23, "NN", 5000, "II")]
    frame = spark.createDataFrame(rows, "c string, id int, q string, o int, u string")
    for qual in (None, "u"):
        found = consensus.reject_outliers(frame, ["c"], ["id"], "q", "o", 0.25, qual)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("posexplode") == 2 and "Window" not in plan  # both of them for votes
        votes, wrong = defaultdict(Counter), Counter()
        for c, _, q, o, u in rows:
            for k, b in enumerate((q or "").upper()):
                if b in "ACGT":
                    votes[c, o + k][b] += 1000000 + (ord(u[k]) - 33 if qual else 0)
        best = {at: min("ACGT", key=lambda b: (-n[b], b)) for at, n in votes.items()}
        for c, i, q, o, _ in rows:
            if q and c in ("a", "b"):
                wrong[c, i] += sum(b != best.get((c, o + k), "A") for k, b in enumerate(q.upper()))
        size = {c: max(col for x, col in votes if x == c) + 1 for c in ("a", "b")}
        want = {(c, i): (n, n <= math.ceil(0.25 * size[c])) for (c, i), n in wrong.items()}
        assert {(r["c"], r["id"]): (r["mismatches"], r["kept"]) for r in found.collect()} == want
