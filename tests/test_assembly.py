"""Assembly and normalisation on planted sequences."""

import random

import pytest

from spanloom.operators import assembly, normalise


def tiled(seq, size, step):
    return [seq[i : i + size] for i in range(0, len(seq) - size + 1, step)]


def test_planted_sequence_is_assembled(spark):
    draw = random.Random(1)
    seq = "".join(draw.choice("ACGT") for _ in range(260))
    reads = tiled(seq, 60, 10)
    wrong = list(reads[7])
    wrong[30] = "A" if wrong[30] != "A" else "C"
    shuffled = [*reads, "".join(wrong), reads[3]]
    draw.shuffle(shuffled)
    rows = [("g", i, s, 2) for i, s in enumerate(shuffled)] + [("n", 0, "ACGNNN", 2), ("e", 0, None, 2)]
    found = assembly.assemble_groups(spark.createDataFrame(rows, "g string, i long, seq string, layer int"), "g", "seq", "layer", ["i"], 15, 60).collect()
    assert {r["g"]: (r["status"], r["seq"]) for r in found if r["contig"] <= 0} == {"g": ("OK", seq), "n": ("NO_SEQUENCE", None), "e": ("NO_SEQUENCE", None)}


def test_layers_keep_their_order():
    seqs, layers = ["CCCGTAT", "GTATACA"], [3, 1]
    assert assembly.overlap_graph(seqs, layers, 4, 0) == [{}, {}]
    assert assembly.overlap_graph(seqs, [1, 3], 4, 0) == [{1: (4, 4)}, {}]


def test_cycles_and_sizes():
    assert assembly.reverse_order([{1: (1, 1)}, {0: (1, 1)}, {}]) == [2]
    repeat = "ACGGTCATTGCA"
    assert assembly.assemble([(x, 2, True, True) for x in tiled(repeat * 4, 16, 3)], 12, 16)[0] == "HAS_CYCLE"
    many = [("ACGT" + format(i, "012b").replace("0", "A").replace("1", "C"), 2, True, True) for i in range(assembly.MOST_READS)]
    assert assembly.assemble(many, 15, 16)[0] == "TOO_MANY_READS"


def test_heaviest_paths_respect_permissions():
    edges = [{1: (5, 5), 2: (9, 9)}, {3: (5, 5)}, {}, {}]
    assert assembly.heaviest_paths(edges, [True] * 4, [True] * 4) == [[0, 1, 3]]
    assert assembly.heaviest_paths(edges, [True] * 4, [True, True, True, False]) == [[0, 2]]
    assert assembly.heaviest_paths(edges, [False, True, False, False], [True] * 4) == [[1, 3]]


@pytest.mark.parametrize("reach", [2, 64])
def test_insertions_roll_left(spark, reach):
    draw = random.Random(2)
    ref = "".join(draw.choice("AC") for _ in range(120)) + "ACACACACACACAC" + "".join(draw.choice("AC") for _ in range(60))
    calls, donors = [], {}
    for i in range(40):
        start = draw.randint(5, 180)
        end = start + draw.choice([0, 0, 0, 3])
        seq = draw.choice(["AC", "CACA", ref[start + 1 : end + 1] + "CC", "A", "CAC"])
        calls.append((f"i{i}", "c", start, end, seq, 7))
        donors[f"i{i}"] = ref[: start + 1] + seq + ref[end + 1 :]
    calls.append(("cut", "c", 50, 50, "AC-CA", 7))
    chunks = spark.createDataFrame([("c", n, ref[n * 50 : n * 50 + 50]) for n in range(-(-len(ref) // 50))], "contig string, chunk_id long, chunk string")
    df = spark.createDataFrame(calls, "id string, contig string, start long, end long, seq string, other int")
    found = {r["id"]: r for r in normalise.left_normalise(df, chunks, 50, reach).collect()}
    assert found and "cut" not in found
    for i, r in found.items():
        assert ref[: r["start"] + 1] + r["seq"] + ref[r["end"] + 1 :] == donors[i] and r["other"] == 7
        if r["start"] == r["end"] and r["seq"]:
            assert ref[r["start"]] != r["seq"][-1]


def test_seeded_overlaps_equal_all_pairs():
    import time

    from spanloom.functions.align import suffix_prefix

    draw = random.Random(17)
    text = "".join(draw.choices("ACGT", k=400)) + "AC" * 40
    seqs = ["".join(c if draw.random() > 0.01 else draw.choice("ACGT") for c in text[a : a + draw.randint(10, 70)]) for a in draw.choices(range(440), k=70)]
    for least, mismatches in ((15, 1), (15, 0), (21, 2)):
        found = assembly.seeded_overlaps(seqs, least, mismatches)
        want = {}
        for i, a in enumerate(seqs):
            for j, b in enumerate(seqs):
                tries = [(n - 5 * m, n) for n in range(least, min(len(a), len(b)) + 1) if (m := sum(x != y for x, y in zip(a[len(a) - n :], b, strict=False))) <= mismatches]
                if i != j and tries:
                    want[i, j] = max(tries)[::-1]
        assert found == want
        if mismatches < 2:
            for (i, j), (n, score) in found.items():
                assert suffix_prefix(seqs[i], seqs[j], 1, -4, 1e-9 if mismatches else 0.0, least, mismatches)[:2] == (n, score)
    donor = "".join(draw.choices("ACGT", k=5000))
    began = time.monotonic()
    assembly.assemble([(donor[3 * k : 3 * k + 100], 2, True, True) for k in range(999)], 15, 100)
    assert time.monotonic() - began < 10
