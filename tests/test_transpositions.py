"""Region scoring against brute force, and transposed insertions from simulated reads to variant lines."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.functions.align import DEFAULT, PERMISSIVE, Scoring, align, encode, gaps_may_pay, locate, locate_many, locate_ungapped
from spanloom.operators import scoring, seeds
from spanloom.plans import transpositions
from spanloom.plans.config import Config
from spanloom.shared import Scratch


def dna(draw, n):
    return "".join(draw.choices("ACGT", k=n))


def turned(s):
    return s[::-1].translate(str.maketrans("ACGTN", "TGCAN"))


def noisy(draw, s, share):
    out = []
    for c in s:
        r = draw.random()
        out.append(draw.choice("ACGT") if r < share else "" if r < 1.2 * share else c + draw.choice("ACGT") if r < 1.4 * share else c)
    return "".join(out)


def test_many_are_located_as_one():
    draw = random.Random(3)
    for s in (DEFAULT, PERMISSIVE):
        text = dna(draw, 300)
        queries = [noisy(draw, text[a : a + draw.randint(5, 90)], 0.08) for a in range(0, 290, 7)] + ["", "N" * 9, dna(draw, 40)]
        found = locate_many(queries, text, s)
        assert found == [locate(q, text, s) for q in queries]
        for q, f in zip(queries, found, strict=True):
            a = align(q, text, s)
            assert (f is None) == (a is None) and (a is None or f == (a.score, a.ref_begin, a.ref_end, a.query_begin, a.query_end))


def test_queries_for_which_no_gap_pays_are_located_together_as_alone():
    draw = random.Random(5)
    for s in (Scoring(1, 100, 100, 100), Scoring(1, 4, 30, 1), Scoring(2, 3, 80, 2), Scoring(1, 0, 30, 1), Scoring(3, 9, 300, 1, True)):
        texts = [dna(draw, n) for n in (200, 1, 0, 90)] + ["A" * 50, "ACNNNNAC" * 9]
        of = np.array([draw.randrange(len(texts)) for _ in range(150)])
        queries = [noisy(draw, (texts[t][draw.randint(0, 60) :] + dna(draw, 9))[: draw.randint(0, 50)], 0.05)[:60] for t in of]
        ends = lambda parts: np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        assert not any(gaps_may_pay(len(q), s) for q in queries)
        found = locate_ungapped(encode("".join(queries)), ends(queries), encode("".join(texts)), ends(texts), of, s, np.arange(len(of)))
        assert [None if not f[0] else tuple(f) for f in found.tolist()] == [locate(q, texts[t], s) for q, t in zip(queries, of, strict=True)]


def test_many_short_queries_take_microseconds_each():
    draw = random.Random(6)
    queries, texts = dna(draw, 18 * 40_000), dna(draw, 360 * 2_000)
    begun = time.monotonic()
    found = locate_ungapped(encode(queries), np.arange(40_001) * 18, encode(texts), np.arange(2_001) * 360, np.repeat(np.arange(2_000), 20), Scoring(1, 100, 100, 100), np.arange(40_000))
    assert time.monotonic() - begun < 4 and (found[:, 0] > 3).all()  # one at a time they take longer than that


def test_stretches_need_no_index_where_no_gap_pays(spark):
    """Also with long queries and other letters among them."""
    draw, scoring = random.Random(8), Scoring(1, 3, 20, 2)
    text = dna(draw, 700)
    reference = spark.createDataFrame([("c", i, text[i * 256 : (i + 1) * 256]) for i in range(3)], "contig string, chunk_id long, chunk string")
    queries = [(g, i, q) for g in (0, 1) for i, q in enumerate([text[300:330], text[10:30] + "\u00e9" + text[31:38], text[400:450] + text[455:500], "", None, "\u00e9", dna(draw, 25)])]
    stretches = spark.createDataFrame([(0, "c", 0, 700), (1, "c", 250, 650)], "g int, contig string, low long, high long")
    for index in (None, seeds.seed_index(reference, 256)):
        found = seeds.align_to_stretches(stretches, spark.createDataFrame(queries, "g int, m int, q string"), ["g"], ["m"], reference, index, 256, scoring)
        got = {(r["g"], r["m"]): (r["score"], r["start"], r["end"], r["left_clip"], r["right_clip"]) for r in found.collect()}
        want = {}
        for g, m, q in queries:
            low, high = ((0, 700), (250, 650))[g]
            if q and (f := locate(q, text[low:high], scoring)) is not None:
                want[g, m] = (f[0], low + f[1], low + f[2], f[3], len(q) - 1 - f[4])
        assert got == want and len(want) == 8


@pytest.mark.parametrize("share", [0.0, 0.03, 0.15])
def test_seeds_find_what_the_whole_stretch_holds(spark, share):
    """Scores and places by seeds equal those of aligning to everything, also where seeds are missing and across chunks."""
    draw = random.Random(int(share * 100))
    text = dna(draw, 3000)
    text = text[:1500] + text[200:420] + text[1500:]  # a repeat: of equal places the first counts
    reference = spark.createDataFrame([("c", i, text[i * 256 : (i + 1) * 256]) for i in range(-(-len(text) // 256))], "contig string, chunk_id long, chunk string")
    stretches = [(g, "c", low, high) for g, (low, high) in enumerate([(0, len(text)), (100, 1900), (1400, 1800), (700, 700)])]
    queries = [(g, 10 * g + i, noisy(draw, text[a : a + draw.choice([20, 60, 150])], share)) for g in range(4) for i, a in enumerate(draw.choices(range(2900), k=10))]
    queries += [(0, 1000, None), (0, 1001, ""), (1, 1002, "N" * 30)]
    index = seeds.seed_index(reference, 256)
    found = seeds.align_to_stretches(spark.createDataFrame(stretches, "g int, contig string, low long, high long"), spark.createDataFrame(queries, "g int, m int, q string"), ["g"], ["m"], reference, index, 256)
    got = {(r["g"], r["m"]): (r["score"], r["start"], r["end"], r["left_clip"], r["right_clip"]) for r in found.collect()}
    want = {}
    for g, m, q in queries:
        low, high = stretches[g][2:]
        if q and high > low and (f := locate(q, text[low:high], DEFAULT)) is not None:
            want[g, m] = (f[0], low + f[1], low + f[2], f[3], len(q) - 1 - f[4])
    assert got == want and len(want) > 25


def simulate(first, second, reverse, novel, seed, changes=()):
    """Two contigs; a piece of the second, turned or not, or one that is nowhere, is put into the first. Pairs of 100 letters from
    fragments of 300 to 500, mapped as an aligner would: whole reads, and those over a breakpoint clipped."""
    draw = random.Random(seed)
    a, b, at = dna(draw, 6000), dna(draw, 6000), 3000
    piece = dna(draw, 400) if novel else b[2500:3000]
    for i in changes:  # letters in which the sample differs from where its sequence comes from
        piece = piece[:i] + "ACGT"["CGTA".index(piece[i])] + piece[i + 1 :]
    donor = a[:at] + (turned(piece) if reverse else piece) + a[at:]
    n = len(piece)

    def mapped(s, e):
        """contig, pos, cigar, and whether donor[s:e] lies on the other strand there."""
        if e <= at:
            return first, s, f"{e - s}M", False
        if s >= at + n:
            return first, s - n, f"{e - s}M", False
        if s >= at and e <= at + n:
            if novel:
                return None
            return (second, 2500 + (n - (e - at)), f"{e - s}M", True) if reverse else (second, 2500 + s - at, f"{e - s}M", False)
        left, right = max(0, at - s), max(0, e - at - n)
        if left >= 30 and left >= right:
            return first, s, f"{left}M{e - s - left}S", False
        return (first, at, f"{e - s - right}S{right}M", False) if right >= 30 else None

    rows = []
    for i in range(1500):
        size = draw.randint(300, 500)
        s = draw.randint(1200, len(donor) - 1200 - size)
        ends = [(s, s + 100, False), (s + size - 100, s + size, True)]
        places = [mapped(x, y) for x, y, _ in ends]
        for k in (0, 1):
            me, mate = places[k], places[1 - k]
            if me is None and mate is None:
                continue
            seq = donor[ends[k][0] : ends[k][1]]
            back, mate_back = [p is not None and (p[3] != e[2]) for p, e in ((me, ends[k]), (mate, ends[1 - k]))]
            flag = 1 | (0x40 if k == 0 else 0x80) | (0x10 if back else 0) | (0x20 if mate_back else 0) | (4 if me is None else 0) | (8 if mate is None else 0)
            here, there = me or (mate[0], mate[1]), mate or (me[0], me[1])
            same = me is not None and mate is not None and here[0] == there[0]
            flag |= 2 if same and abs(here[1] - there[1]) < 2000 else 0
            shown = turned(seq) if (ends[k][2] if me is None else me[3]) else seq
            rows.append((f"{first}{i}", flag, here[0], here[1], 60 if me else 0, me[2] if me else None, there[0], there[1], there[1] - here[1] if same else 0, shown, "I" * 100, mate[2] if mate else None, 60 if mate else 0, 0))
    return {first: a, second: b}, donor, rows


SCHEMA = "file_ord long, qname string, flag int, contig string, pos long, mapq int, cigar string, mate_contig string, mate_pos long, isize long, seq string, qual string, mc string, mq int, nm int"
CONFIG = Config(max_is=600, read_len=100)


@pytest.fixture(scope="module")
def planted(spark):
    """A copy, a turned copy that differs in some letters from where it comes from, and a sequence that is nowhere else."""
    contigs, donors, rows = {}, {}, []
    for seed, (first, second, reverse, novel) in enumerate([("a", "b", False, False), ("c", "d", True, False), ("e", "f", False, True)]):
        some, donors[first], more = simulate(first, second, reverse, novel, seed + 1, (120, 121, 250, 380) if reverse else ())
        contigs |= some
        rows += more
    reads = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)
    chunks = [(c, i, s[i * 500 : (i + 1) * 500]) for c, s in contigs.items() for i in range(-(-len(s) // 500))]
    return contigs, donors, reads, spark.createDataFrame(chunks, "contig string, chunk_id long, chunk string")


def test_planted_insertions_are_called(spark, planted):
    contigs, donors, reads, reference = planted
    calls = transpositions.discordant_insertions(reads, reference, CONFIG, 500).cache()
    found = {r["contig"]: r for r in calls.collect()}
    assert set(found) == {"a", "c", "e"} and calls.count() == 3
    for contig, call in found.items():
        whole = contigs[contig]
        assert whole[: call["start"] + 1] + call["seq"] + whole[call["end"] + 1 :] == donors[contig]
        assert call["r_disc"] > 10 and call["l_disc"] > 10 and call["r_fwd"] + call["r_rev"] > 1
    for contig, source, reverse, name in (("a", "b", False, "T_INS_0"), ("c", "d", True, "T_INS_1")):
        call = found[contig]
        assert (call["id"], call["source"], call["source_reverse"]) == (name, source, reverse)
        assert abs(call["source_start"] - 2500) < 30 and abs(call["source_end"] - 2999) < 30
        assert call["precise"]
    assert (found["e"]["id"], found["e"]["source"], found["e"]["precise"]) == ("A_INS_0", None, None)
    judged = transpositions.annotate_filters(calls, reads, CONFIG, (5, 200), 25).cache()
    assert {r["id"]: r["filter"] for r in judged.collect()} == {r["id"]: ["PASS"] for r in found.values()}
    assert all(10 < r["left_depth"] < 100 and 10 < r["right_depth"] < 100 for r in judged.collect())
    assert {r["id"]: r["filter"] for r in transpositions.annotate_filters(calls, reads, CONFIG, (5, 6), 25).collect()} == {i: ["ANOMALOUS_DEPTH"] if i[0] == "A" else ["ANOMALOUS_DEPTH", "ANOMALOUS_SC_NUMBER"] for i in ("T_INS_0", "T_INS_1", "A_INS_0")}
    lines = {r["id"]: r["line"].split("\t") for r in transpositions.vcf_lines(judged, reference, 500).collect()}
    line = lines["T_INS_0"]
    assert line[:3] == ["a", str(found["a"]["start"] + 1), "T_INS_0"] and "ALGORITHM=transurveyor" in line[7] and f"SVINSSEQ={found['a']['seq']}" in line[7]
    assert "ALGORITHM=assembly" in lines["A_INS_0"][7] and not any("IMPRECISE" in line[7] for line in lines.values())


def test_no_discordant_reads_no_calls(planted):
    _, _, reads, reference = planted
    proper = reads.where(F.col("flag").bitwiseAND(2) != 0)
    assert transpositions.discordant_insertions(proper, reference, CONFIG, 500).count() == 0


def test_stitched_flanks_stand_once():
    draw = random.Random(9)
    x, y, z = dna(draw, 80), dna(draw, 120), dna(draw, 80)
    assert transpositions.stitch(x, y, z, 15) == x + y + z
    assert transpositions.stitch(x, x[-20:] + y, z, 15) == x + y + z
    assert transpositions.stitch(x, y + z[:25], z, 15) == x + y + z


def test_limits_windows_and_votes(spark):
    """Scores of a region by the plain statement, with two places that reads are drawn to."""
    draw = random.Random(12)
    text = dna(draw, 4000)
    reference = spark.createDataFrame([("c", i, text[i * 512 : (i + 1) * 512]) for i in range(8)], "contig string, chunk_id long, chunk string")
    members = [(1, "R", i, False, turned(text[1000 + 15 * i : 1080 + 15 * i])) for i in range(10)]
    members += [(1, "R", 10 + i, False, turned(text[3000 + 9 * i : 3080 + 9 * i])) for i in range(3)]  # too far away: outside the window
    members += [(1, "L", 20 + i, False, text[1300 + 11 * i : 1380 + 11 * i]) for i in range(8)]
    members += [(1, "L", 30, True, text[1440:1500])]
    frame = spark.createDataFrame(members, "cluster long, side string, member long, clip boolean, seq string")
    regions = spark.createDataFrame([(1, 7, "c", 200, 3900), (1, 8, "c", 0, 900)], "cluster long, region long, contig string, low long, high long")
    tables = Scratch(spark, "test", light=True)
    scores, judged = scoring.score_regions(frame, regions, reference, 500, 512, tables)
    best = scoring.best_regions(scores, regions).collect()
    assert [(r["region"], r["rc"], r["first"], r["last"]) for r in best] == [(7, False, 1000, 1499)]
    row = {r["rc"]: r for r in scores.where("region = 7").collect()}
    fit = {r["member"] for r in judged.where("region = 7 and not rc and accepted").collect()}
    assert fit == {*range(10), *range(20, 28), 30} and row[False]["accepted"] == 18 and row[False]["reads"] == 21
    # The clip counts twice a letter; the reads are whole, but for the one that ends with the window.
    assert row[False]["total"] == sum(r["score"] for r in judged.where("region = 7 and not rc and accepted").collect())
    assert row[True]["total"] < 200
