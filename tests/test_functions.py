"""Column functions by hand vectors, and the aligner against the textbook recurrence."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanloom.functions import align as A
from spanloom.functions import cigar as C
from spanloom.functions import flags as P
from spanloom.functions import sequences as S
from spanloom.functions import vcf as V


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_cigar(spark):
    c = F.lit("5S10M2D3I7M4S")
    assert one(spark, C.reference_length(c), C.query_length(c), C.left_clip(c), C.right_clip(c), C.end_position(F.lit(100), c), C.unclipped_start(F.lit(100), c), C.unclipped_end(F.lit(100), c)) == (19, 29, 5, 4, 119, 95, 123)
    none = F.lit(None).cast("string")
    assert one(spark, C.reference_length(none), C.left_clip(none), C.mate_end(F.lit(7), none), C.mate_end(F.lit(7), F.lit("3S10M5I2D"))) == (0, 0, 7, 18)
    assert tuple(one(spark, C.indels_in_first(c, 16))[0]) == (1, 0)
    assert tuple(one(spark, C.indels_in_first(c, 18))[0]) == (2, 3)
    assert one(spark, C.to_text(C.ops(c))) == ("5S10M2D3I7M4S",)


def test_flags(spark):
    f = F.lit
    assert one(spark, P.is_primary(f(0x100)), P.is_primary(f(3)), P.is_proper_pair(f(0x802)), P.is_same_strand(f(0)), P.is_same_strand(f(0x30))) == (False, True, False, True, False)
    assert one(spark, P.is_discordant(f(1), f("a"), f("a"), f(100_000)), P.is_discordant(f(1), f("a"), f("a"), f(100_001)), P.is_discordant(f(1), f("a"), f("b"), f(1)), P.is_discordant(f(5), f("a"), f("a"), f(1))) == (False, True, True, True)
    assert one(spark, P.is_mate_clipped(f("5S9M")), P.is_mate_clipped(f("5S9M2S")), P.is_mate_clipped(f(None).cast("string"))) == (False, True, False)
    assert one(spark, P.stable_end(f(0), f("9M"), f(5), f(5), 3), P.stable_end(f(16), f("9M"), f(5), f(5), 3), P.stable_end(f(0), f("4S9M"), f(5), f(5), 3), P.stable_end(f(0), f("9M"), f(4), f(5), 3)) == ("R", "L", None, None)
    assert one(spark, P.mate_key(f("q"), f(0x40), f(True)), P.mate_key(f("q"), f(0x40), f(True), own=False), P.mate_key(f("q"), f(0x40), f(False))) == ("q_1", "q_2", "q")


def test_sequences(spark):
    f = F.lit
    assert one(spark, S.reverse_complement(f("acgTN")), S.mean_quality(f("!5")), S.mean_quality(f("")), S.is_homopolymer(f("AAAAC")), S.is_homopolymer(f("AAACC")), S.is_homopolymer(f("NN"))) == ("NACGT"[0:1] + "ACGT", 10.0, None, True, False, False)
    assert one(spark, S.overlap(f(1), f(5), f(3), f(9)), S.overlap(f(1), f(3), f(3), f(9)), S.hamming(f("abcd"), f("abxy")), S.exact_suffix_prefix(f("AACG"), f("CGT"), 1)) == (2, 0, 2, 2)
    assert tuple(one(spark, S.fold_microhomology(f(9).cast("long"), f(6).cast("long"), f("acg"), f("TT")))[0]) == (6, "ACGTT", 3)


def test_vcf(spark):
    info = V.info_map(F.lit("END=11;SVLEN=-5;IMPRECISE"))
    assert one(spark, V.sv_end(info, F.lit(3).cast("long")), V.sv_end(V.info_map(F.lit("SVLEN=-5")), F.lit(3).cast("long")), V.inserted_sequence(info, F.lit("<INS>")), V.inserted_sequence(info, F.lit("ACG"))) == (10, 8, "", "CG")
    with pytest.raises(Exception, match="neither END nor SVLEN"):
        one(spark, V.sv_end(V.info_map(F.lit(".")), F.lit(3).cast("long")))
    assert V.header([("x", 9)], "s")[-1].endswith("FORMAT\ts")


def textbook(q, r, s):
    n, m, low = len(q), len(r), -(10**9)
    h = [[0] * (m + 1) for _ in range(n + 1)]
    e = [[low] * (m + 1) for _ in range(n + 1)]
    f = [[low] * (m + 1) for _ in range(n + 1)]
    best = 0
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            a, b = q[i - 1], r[j - 1]
            gain = s.match if a == b != "N" or s.n_matches and "N" in (a, b) else -s.mismatch
            e[i][j] = max(e[i][j - 1] - s.gap_extend, h[i][j - 1] - s.gap_open)
            f[i][j] = max(f[i - 1][j] - s.gap_extend, h[i - 1][j] - s.gap_open)
            h[i][j] = max(0, h[i - 1][j - 1] + gain, e[i][j], f[i][j])
            best = max(best, h[i][j])
    return best


@pytest.mark.parametrize("scoring", [A.DEFAULT, A.PERMISSIVE, A.TO_BASE, A.HARSH])
def test_align_scores_and_cigars(scoring):
    draw = random.Random(1)
    for _ in range(150):
        q = "".join(draw.choice("ACGTN") for _ in range(draw.randint(1, 25)))
        r = "".join(draw.choice("ACGTN") for _ in range(draw.randint(1, 40)))
        a = A.align(q, r, scoring)
        assert (a.score if a else 0) == textbook(q, r, scoring)
        if a:
            i, j, total = a.query_begin, a.ref_begin, 0
            for n, op in re.findall(r"(\d+)([=XID])", a.cigar):
                n = int(n)
                if op in "=X":
                    for x, y in zip(q[i : i + n], r[j : j + n], strict=True):
                        total += scoring.match if x == y != "N" or scoring.n_matches and "N" in (x, y) else -scoring.mismatch
                    i, j = i + n, j + n
                else:
                    total -= scoring.gap_open + (n - 1) * scoring.gap_extend
                    i, j = i + n * (op == "I"), j + n * (op == "D")
            assert (total, i, j) == (a.score, a.query_end + 1, a.ref_end + 1)
    assert A.align("", "ACG") is None and A.align("NN", "ACG") is None


@settings(max_examples=100, deadline=None)
@given(st.text("ACG", max_size=14), st.text("ACG", max_size=14), st.sampled_from([0.0, 0.2]), st.integers(1, 4))
def test_suffix_prefix(a, b, error, least):
    tries = []
    for n in range(least, min(len(a), len(b)) + 1):
        m = sum(x != y for x, y in zip(a[len(a) - n :], b[:n], strict=True))
        if m <= (max(1, int(n * error)) if error else 0):
            tries.append((n - m - 4 * m, n, m))
    best = max(tries, default=None)
    assert A.suffix_prefix(a, b, error=error, least=least) == (None if best is None else (best[1], best[0], best[2]))
