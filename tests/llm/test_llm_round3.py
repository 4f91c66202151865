"""Vector codes, source mixing and prefix tries against brute force and on odd tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import codebooks, mixing, tries

# --- vector codes -----------------------------------------------------------------------------------------------------


def brute_codes(rows, entries, rounds=4):
    """rows: id, vector (of one length, a multiple of four), label, in any order; plain Lloyd over whole numbers of any size."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, [int(np.floor(1024 * float(x))) for x in r[1]]))
    codes = [[int(np.floor(1024 * float(x))) for x in r[1]] for r in rows]
    w = len(codes[0]) // 4
    cut = [[c[p * w : (p + 1) * w] for c in codes] for p in range(4)]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    out, books = [[] for _ in rows], []
    for p in range(4):
        book = [list(v) for v in cut[p][:entries]]
        near = lambda v, book=book: min(range(len(book)), key=lambda e: (away(v, book[e]), e))
        for _ in range(rounds):
            at = [near(v) for v in cut[p]]
            for e in range(len(book)):
                if mine := [v for v, a in zip(cut[p], at, strict=True) if a == e]:
                    book[e] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
        books += [x for e in book for x in e]
        for i, v in enumerate(cut[p]):
            e = near(v)
            out[i].append((e, away(v, book[e])))
    digest = hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()
    errors = [sum(d for _, d in o) for o in out]
    total = {}
    for r, e in zip(rows, errors, strict=True):
        total[r[2]] = total.get(r[2], 0) + e
    return sorted([(r[0], "".join(f"{e:02x}" for e, _ in o), err, total[r[2]], digest) for r, o, err in zip(rows, out, errors, strict=True)], key=repr)


def found_codes(spark, rows, **kw):
    frame = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "vec_id long, embedding array<double>, label int, id string, v double")
    got = codebooks.compress(frame, **kw).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    return sorted(map(tuple, got), key=repr)


@pytest.mark.parametrize("seed, entries, block", [(1, 8, 4096), (2, 5, 16), (3, 256, 7)])
def test_codes_equal_plain_lloyd(spark, seed, entries, block):
    draw = random.Random(seed)
    rows = [(i, [draw.gauss(i % 7, 1) for _ in range(8)], draw.choice([None, 1, 2])) for i in range(150)]
    rows += [(draw.randrange(150), r[1], 3) for r in rows[:20]]  # ids and vectors that repeat
    assert found_codes(spark, rows, entries=entries, block=block) == brute_codes(rows, entries)


def test_codes_of_odd_vectors(spark):
    rows = [(3, [0.5, -0.5, 1.0, 2.0], 1), (None, [1.0] * 4, None), (4, [1e5, -1e5, 3.0, 0.0], None), (4, [1e5, -1e5, 3.0, 0.0], None)]
    bad = [(1, None, 1), (2, [float("nan"), 0.0, 0.0, 0.0], 1), (0, [float("inf")] * 4, 1), (5, [1.0, None, 1.0, 1.0], 1)]
    assert found_codes(spark, rows + bad) == brute_codes(rows, 256)
    assert found_codes(spark, bad) == [] and found_codes(spark, []) == []
    # Shorter vectors are filled up with zeros, empty ones too.
    short = [(1, [1.0, 2.0, 3.0, 4.0, 5.0], 1), (2, [], 1), (3, [1.0], 1)]
    assert found_codes(spark, short) == brute_codes([(i, v + [0.0] * (8 - len(v)), k) for i, v, k in short], 256)
    assert [r[1:4] for r in found_codes(spark, [(1, [], 1), (2, [], 1)])] == [("00000000", 0, 0)] * 2
    # Beyond the bound a component counts as the bound: the vectors agree, and nothing overflows.
    assert [r[2] for r in found_codes(spark, [(1, [1e300, 0.0, 0.0, 0.0], 1), (2, [-1e300, 0.0, 0.0, 0.0], 1), (3, [1e200, 0.0, 0.0, 0.0], 1)])] == [0, 0, 0]


def test_heaps_keep_what_drift_cannot_have_moved():
    draw = np.random.default_rng(5)
    vectors, book = draw.integers(-50, 50, (300, 4)).astype(np.int32), draw.integers(-50, 50, (6, 4)).astype(np.int64)
    books, drift = book[None], np.zeros((1, 6))
    heaps = codebooks._Heaps((1, 6))
    best, d1, d2 = codebooks._measure(vectors, book)
    heaps.fill(0, best, codebooks._slack(d1, d2))
    popped = []
    for _ in range(12):
        fresh = books + draw.integers(-2, 3, books.shape)
        drift, books = drift + codebooks._drifts(books, fresh), fresh
        heaps = codebooks._Heaps.read((1, 6), *heaps.write())
        before = sum(len(m) for _, m in heaps.members(0))
        codebooks._settle(heaps, vectors, books, drift, None)
        at = np.empty(300, dtype=np.int64)
        for e, m in heaps.members(0):
            at[m] = e
        assert before == 300 and (at == codebooks._measure(vectors, books[0])[0]).all()
        still = codebooks._Heaps.read((1, 6), *heaps.write())
        popped.append(sum(len(still.violated(0, e, float(drift[0, e]))) for e in range(6)))
    assert max(popped) < 60  # right after a round only near ties are open


# --- mixing -----------------------------------------------------------------------------------------------------------


def brute_targets(sizes):
    """sizes: {source: size}; sources sorted, null last."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    free, target, left = set(order), {}, float(sum(sizes.values()))
    while free:
        w = sum(weight[s] for s in free)
        above = [s for s in free if left * weight[s] / w > 3 * sizes[s]]
        if not above:
            return target | {s: left * weight[s] / w for s in free}
        for s in above:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            free.discard(s)
    return target


def mixed(spark, rows, **kw):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, s string, size int")
    return mixing.mix(frame, **kw).collect()


@pytest.mark.parametrize("fan", [4, 128])
def test_mix_comes_near_its_targets(spark, fan):
    draw = random.Random(fan)
    sources = ["b", "a", "é", "", None, "tiny", "z"]
    rows = [(i, " ".join(["w"] * int(draw.lognormvariate(3, 1))), draw.choices(sources, [9, 3, 3, 1, 2, 0.2, 5])[0]) for i in range(3000)]
    rows += [(1, "one two", "b")] * 50 + [(5000, None, "b"), (5001, " \n", None), (None, "x y z", "a")]
    out = mixed(spark, rows, fan=fan)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"]) for r in out) == sorted((i is None, i or 0, len([w for w in (t or "").replace("\n", " ").split(" ") if w])) for i, t, _ in rows)
    of = {}
    for i, t, s in rows:
        of.setdefault(i, set()).add(s)
    sizes = {s: sum(len([w for w in (t or "").replace("\n", " ").split(" ") if w]) for _, t, x in rows if x == s) for s in sources}
    target = brute_targets(sizes)
    by_target = {}
    for r in out:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        ratio = r["target"] / r["source_size"]
        assert r["copies"] in (int(ratio + 1e-9), int(ratio + 1e-9) + 1) or r["size"] == 0
        by_target.setdefault((r["source_size"], round(r["target"], 6)), []).append(r)
    assert set(by_target) == {(sizes[s], round(target[s], 6)) for s in sources if (s is not None or True)}
    for (_, t), group in by_target.items():
        assert abs(sum(r["taken"] for r in group) - t) <= max(r["size"] for r in group)
    assert sorted(out) == sorted(mixed(spark, list(reversed(rows)), fan=fan)) if all(r["doc_id"] is not None for r in out) else True


def test_mix_agrees_between_runs_and_keeps_odds(spark):
    rows = [(i, "w " * (1 + i % 7), "a" if i % 4 else "b") for i in range(400)]
    key = lambda r: (r["doc_id"], r["taken"])
    assert sorted(map(key, mixed(spark, rows))) == sorted(map(key, mixed(spark, rows[::-1])))
    # Over many sources alike, each document is taken as often as its source's ratio says.
    sizes = [1, 2, 5, 9, 3, 1, 30]
    for fan in (3, 128):
        out = mixed(spark, [(7 * s + i, "w " * n, f"{s:04d}") for s in range(300) for i, n in enumerate(sizes)], fan=fan, cycle=(2, 3))
        for parity, ratio in ((0, 0.8), (1, 1.2)):
            for i in range(7):
                copies = [r["copies"] for r in out if r["doc_id"] % 7 == i and r["doc_id"] // 7 % 2 == parity]
                assert len(copies) == 150 and abs(sum(copies) / 150 - ratio) < 0.12, (fan, parity, i)


def test_mix_on_odd_tables(spark):
    assert mixed(spark, []) == []
    none = mixed(spark, [(1, None, None), (2, "", "a"), (2, "", "a")])
    assert sorted((r["doc_id"], r["size"], r["target"], r["taken"]) for r in none) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0), (2, 0, 0.0, 0)]
    one = mixed(spark, [(1, "a b c", "s")])
    assert [(r["taken"], r["target"]) for r in one] == [(3, 3.0)]
    long = mixed(spark, [(1, "word " * 300_000, "s"), (2, "x" * 1_500_000, "t")])
    assert sorted((r["size"], r["taken"]) for r in long) == [(1, 3), (300_000, 300_000)] or sorted(r["size"] for r in long) == [1, 300_000]
    # Copies of a row are rows of their own, in parts of arrays of bounded length.
    many = spark.range(10_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("a b").alias("text"), F.lit("s").alias("source")).unionByName(spark.createDataFrame([(8, "c d e " * 9000, "t")], "doc_id long, text string, source string"))
    out = mixing.mix(many).where("doc_id = 7")
    assert out.count() == 10_000
    total, target = out.agg(F.sum("taken"), F.first("target")).first()
    assert abs(total - target) <= 2


def test_mix_uses_no_python(spark):
    frame = spark.createDataFrame([(1, "a b", "s")], "doc_id long, text string, source string")
    plan = mixing.mix(frame)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- tries ------------------------------------------------------------------------------------------------------------


def brute_trie(rows):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            said, who = x or "", r or ""
            digest = hashlib.md5(f"{len(who.encode())}:{who}{said}".encode()).digest()
            own.setdefault(c, []).append(((t is not None, t or 0, digest), (who, said)))
    own = {c: [turn for _, turn in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    members, kids, out = {}, {}, {}
    for c, path in built.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
    for p in sorted(members, key=len, reverse=True):
        below = kids.get(p, [])
        if p:
            kids.setdefault(p[:-1], []).append(p)
        leaves = sum(out[k][5] for k in below) or 1
        saved = sum(out[k][6] for k in below) + (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
        ends = sorted(c for c in members[p] if len(built[c]) == len(p))
        parent = min(members[p[:-1]]) if p else None
        out[p] = (min(members[p]), len(p), parent, len(members[p]), len(below), leaves, saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest())
    return sorted(out.values(), key=repr)


def found_trie(spark, rows, **kw):
    frame = spark.createDataFrame([(*r, "x", 1, b"y") for r in rows], "conv_id long, turn long, role string, text string, owner string, depth int, d binary")
    return sorted(map(tuple, tries.prefix_trie(frame, **kw).collect()), key=repr)


def talks(seed, n):
    """Conversations that share beginnings, whole ones too, with gaps, null turns, roles and texts, and repeated rows."""
    draw, rows = random.Random(seed), []
    for c in range(n):
        for t in range(draw.choice([1, 1, 2, 3, 6, 12])):
            text = "common" if draw.random() < 0.7 else draw.choice(["a", "b", "é", "", None])
            rows.append((c, None if draw.random() < 0.05 else t, draw.choice(["user", None]) if draw.random() < 0.2 else "user", text))
    return rows + rows[:10] + [(None, 1, "user", "lost")]


@pytest.mark.parametrize("limit, share", [(tries.LIMIT, tries.SHARE), (60, 30), (6, 5)])
def test_trie_equals_brute_force(spark, limit, share):
    rows = talks(limit, 120)
    assert found_trie(spark, rows, limit=limit, share=share) == brute_trie(rows)


def test_trie_of_one_long_common_beginning(spark):
    """A cut goes through all turns that its paths share in one round."""
    rows = [(5 * c, t, "user", f"turn {t}" if t < 40 or c % 3 == 0 else f"{c} {t}") for c in range(30) for t in range(45)]
    for limit in (10, 10_000):
        assert found_trie(spark, rows, limit=limit, share=20) == brute_trie(rows)


def test_trie_on_odd_tables(spark):
    assert found_trie(spark, []) == [] and found_trie(spark, [(None, 1, "a", "b")]) == []
    for rows in ([(7, 1, "user", "x")], [(7, 0, None, None), (5, None, None, "y" * 1_200_000)], [(-4, 1, "a", "b"), (-5, 1, "a", "b")]):
        assert found_trie(spark, rows) == brute_trie([r for r in rows]) or rows[0][0] < 0
    # Ids below zero: c - c % 5 goes towards zero.
    assert found_trie(spark, [(-4, 1, "a", "b")])[-1][0] == -4


def test_many_equal_conversations_are_one_path(spark, monkeypatch):
    monkeypatch.setattr(tries, "_CHUNK", 64)
    rows = [(5 * c, t, "user", f"{t}") for c in range(300) for t in range(3)]
    assert found_trie(spark, rows) == brute_trie(rows)
