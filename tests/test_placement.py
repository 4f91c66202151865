"""Assembled sequences on the reference: planted insertions of every kind, and from reads to calls."""

import random

import pytest

from spanloom.operators import placement


def dna(seed, n):
    return "".join(random.Random(seed).choices("ACGT", k=n))


@pytest.fixture(scope="module")
def ref():
    return dna(21, 600)


def test_an_insertion_is_placed_exactly(ref):
    for seed, size in ((1, 60), (2, 150), (3, 400)):
        extra = dna(seed, size)
        status, call = placement.judge(placement.place([ref[200:300] + extra + ref[300:400]], ref), ref)
        assert status == "OK" and ref[: call.start + 1] + call.seq + ref[call.end + 1 :] == ref[:300] + extra + ref[300:]
        assert call.left_anchor[0] == 200 and call.right_anchor[1] == 399


def test_a_duplication_aligns_over_itself_and_is_cut_once(ref):
    """The inserted sequence is a copy of its neighbourhood, so both halves align over the same bases."""
    extra = ref[240:300]
    status, call = placement.judge(placement.place([ref[150:300] + extra + ref[300:450]], ref), ref)
    assert status == "OK" and len(call.seq) - (call.end - call.start) == 60
    assert ref[: call.start + 1] + call.seq + ref[call.end + 1 :] == ref[:300] + extra + ref[300:]


def test_halves_and_failures(ref):
    extra = dna(5, 500)
    halves = [extra[-200:] + ref[300:420], ref[180:300] + extra[:200]]
    for contigs in (halves, halves[::-1]):
        status, call = placement.judge(placement.place(contigs, ref), ref)
        assert status == "OK" and ref[: call.start + 1] + call.seq + ref[call.end + 1 :] == ref[:300] + extra[:200] + "-" + extra[-200:] + ref[300:]
    assert placement.judge(placement.place([dna(6, 200)], ref), ref)[0] == "BAD_ANCHORS"
    assert placement.judge(placement.place([ref[200:300] + dna(7, 20) + ref[300:400]], ref), ref)[0] == "TOO_SHORT"
    assert placement.judge(None, ref)[0] == "BAD_ANCHORS"


def test_from_reads_to_calls(spark, ref):
    extra = dna(8, 120)
    donor = ref[:300] + extra + ref[300:]
    reads = [(1, donor[s : s + 80], 1 if s < 260 else 3 if s > 400 else 2, s) for s in range(200, 460, 6)]
    reads += [(2, dna(9, 80), 2, 0), (3, None, 2, 0), (4, "ACGTN" * 16, 2, 0)]
    rows = [(g, q, layer, s, "c", ref[100:], 100) for g, q, layer, s in reads]
    df = spark.createDataFrame(rows, "g int, seq string, layer int, s int, contig string, ref string, low long")
    found = {r["g"]: r for r in placement.assembled_insertions(df, "g", ["s"], 15, 80).collect()}
    assert found[1]["status"] == "OK" and ref[: found[1]["start"] + 1] + found[1]["seq"] + ref[found[1]["end"] + 1 :] == donor
    assert found[1]["left_anchor"].endswith(f"-{found[1]['start']}")
    assert found[3]["status"] == found[4]["status"] == "NO_SEQUENCE" and found[2]["status"] in ("BAD_ANCHORS", "NO_SEQUENCE")
