"""Consensus along a sequence: planted gaps, links between contigs, corrections."""

import random

import pytest

from spanloom.operators import assembly, guided
from spanloom.shared import Scratch

READS = "g long, read string, layer int, seq string"


def dna(draw, n):
    return "".join(draw.choices("ACGT", k=n))


def tiles(text, size, step, low=0, high=None):
    return [text[i : i + size] for i in range(low, (len(text) if high is None else high) - size + 1, step)]


def contigs_of(spark, texts, reads):
    frame = spark.createDataFrame([(g, f"{i:05}", layer, s) for i, (g, layer, s) in enumerate(reads)], READS)
    found = guided.guided_contigs(spark.createDataFrame(texts, "g long, text string"), frame, "g", 15, 0.04, 60, Scratch(spark, "test", light=True))
    return found


def test_two_sides_of_a_gap_and_a_link(spark):
    """1: reads on both sides of a gap give the donor's two sides. 2: reads with letters that the text lacks do not align; what they
    assemble to joins the two sides. 3 and 4: no read, and none that aligns."""
    draw = random.Random(5)
    text = dna(draw, 400)
    wrong = text[:150] + ("A" if text[150] != "A" else "C") + text[151:]  # the text has one letter that no read has
    reads = [(1, 2, s) for s in tiles(text, 60, 10, 0, 200) + tiles(text, 60, 10, 230, 400)]
    extra = dna(draw, 25)
    donor = text[:200] + extra + text[200:]
    over = [(2, 2, s) for s in tiles(donor, 60, 5, 150, 290) if extra in s]
    reads += [(2, 1, s) for s in tiles(text, 60, 10, 0, 180)] + [(2, 3, s) for s in tiles(text, 60, 10, 220, 400)]
    reads += over + [(3, 2, None), (3, 2, ""), (4, 2, dna(draw, 60)), (4, 2, "N" * 30)]
    found = contigs_of(spark, [(1, wrong), (2, text), (3, text), (4, text), (5, text)], reads).orderBy("g", "begin").collect()
    got = {g: [(r["seq"], r["begin"], r["end"]) for r in found if r["g"] == g] for g in (1, 2, 3, 4, 5)}
    assert got[1] == [(text[:200], 0, 199), (text[230:], 230, 399)]
    assert got[3] == got[4] == got[5] == []
    assert [s for s, *_ in got[2]] == [donor] and got[2][0][1:] == (0, 399)
    fixed = guided.patched(spark.createDataFrame([(1, wrong, 140, 215), (5, text, 140, 215)], "g long, text string, left_at int, right_at int"), spark.createDataFrame([(1, *c) for c in got[1]], "g long, seq string, begin int, end int"), "g")
    assert {r["g"]: (r["text"], r["left_precise"], r["right_precise"]) for r in fixed.collect()} == {1: (text, True, False), 5: (text, False, False)}


def test_links_are_used_once_in_their_order(spark):
    draw = random.Random(6)
    parts = [dna(draw, 60) for _ in range(4)]
    gap = dna(draw, 20)
    contigs = [(7, s, 100 * i) for i, s in enumerate(parts)]
    links = [(7, 0, parts[0][-20:] + gap + parts[1][:20]), (7, 1, parts[0][-30:] + parts[1][:30]), (7, 2, parts[2][-25:] + parts[3][:18]), (7, 3, parts[2][-30:] + parts[3][:30])]
    found = guided.scaffold(spark.createDataFrame(contigs, "g long, seq string, begin int"), spark.createDataFrame(links, "g long, link int, seq string"), "g", 15, 0.0)
    assert [r["seq"] for r in found.orderBy("n").collect()] == [parts[0] + gap + parts[1], parts[2] + parts[3]]
    # both overlaps of a link may share letters: these stand once
    close = [(1, parts[0] + "ACGTTGCA", 0), (1, "ACGTTGCA" + parts[1], 50)]
    link = [(1, 0, parts[0][-20:] + "ACGTTGCA" + parts[1][:20])]
    one = guided.scaffold(spark.createDataFrame(close, "g long, seq string, begin int"), spark.createDataFrame(link, "g long, link int, seq string"), "g", 15, 0.0).collect()
    assert [r["seq"] for r in one] == [parts[0] + "ACGTTGCA" + parts[1]]


@pytest.mark.parametrize("seed", [1, 2])
def test_paths_equal_trying_all(spark, seed):
    """The first contig is the heaviest of all paths over reads in order of alignment."""
    draw = random.Random(seed)
    text = dna(draw, 160)
    starts = sorted(draw.sample(range(120), 8))
    seqs = [text[a : a + draw.randint(25, 40)] for a in starts]
    ends = [a + len(s) - 1 for a, s in zip(starts, seqs, strict=True)]
    best = {}
    for i in reversed(range(len(seqs))):
        best[i] = 0
        for j in range(i + 1, len(seqs)):
            n = ends[i] + 1 - starts[j]
            if ends[i] - starts[j] >= 15 and n <= min(len(seqs[i]), len(seqs[j])):
                best[i] = max(best[i], n + best[j])
    aligned = spark.createDataFrame([(1, f"{i}", s, a, e) for i, (s, a, e) in enumerate(zip(seqs, starts, ends, strict=True))], "g long, read string, seq string, begin int, end int")
    first = guided._paths(aligned, "g", 15, 0.0, 200).where("n = 0").first()["seq"]
    assert first in text
    if max(best.values()):
        at = text.index(first)
        inside = [i for i in range(len(seqs)) if at <= starts[i] and ends[i] < at + len(first)]
        assert max(best[i] for i in inside) == max(best.values())


def test_large_groups_are_given_up_before_they_are_gathered(spark):
    many = [("big", i, "ACGT" + format(i, "012b").replace("0", "A").replace("1", "C"), 2) for i in range(assembly.MOST_READS)]
    rows = [*many, *[("same", i, "ACGTACGGTTCAGCAT", 2) for i in range(3000)], (None, 1, "ACGT", 1), ("none", 1, "ACNGT", 1)]
    found = assembly.assemble_groups(spark.createDataFrame(rows, "g string, i long, seq string, layer int"), "g", "seq", "layer", ["i"], 15, 16).collect()
    assert {(r["g"], r["status"], r["contig"]) for r in found} == {("big", "TOO_MANY_READS", -1), ("same", "OK", -1), ("none", "NO_SEQUENCE", -1)}
