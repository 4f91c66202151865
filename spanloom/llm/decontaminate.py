"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts are brought to a normal form in which their words stand in single spaces: then a window of words occurs in a text
exactly where its bytes, with a space at both ends, occur. The search looks at blocks of bytes: the shift table says how
far a block is from the end of any pattern's head, so that impossible positions are skipped; where the shift is 0, the
block's bucket names the patterns to compare with the text directly.

The scan runs over many lanes of a batch at once: all lanes read their blocks, shift and test together.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import Scratch, slices, text_key

WINDOW = 10
#: Bytes of distinct benchmark texts that are searched for at a time; a larger benchmark takes several panels, each of about this
#: size (they are dealt by a hash of their text), or of one text that is larger.
PANEL_BYTES = 4 << 20
_TABLE_BITS = 20
_LANE_BYTES = 2048
#: Upper-case letters become lower-case ones, all that is not in a word becomes a space. Bytes from 0x80 belong to words.
_FORM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "replace").translate(_FORM).split()


def _windows(forms: list[list[bytes]], size: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts' normal forms as one, and for each distinct window its place and length in that, its number of words, and the texts
    that have it, as pairs (window, text) in order. Windows are told apart by 128 bits of hash; nothing is kept of each but numbers."""
    joined = [b" " + b" ".join(w) + b" " for w in forms if w]
    data = b"\n".join(joined)
    owner = np.array([i for i, w in enumerate(forms) if w], dtype=np.int64)
    counts = np.array([len(w) for w in forms if w], dtype=np.int64)
    spaces = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 32)
    taken = np.minimum(counts, size)
    number = counts - taken + 1
    head = np.cumsum(counts + 1) - (counts + 1)  # each form's first space
    first = np.repeat(head - (np.cumsum(number) - number), number) + np.arange(number.sum())
    k = np.repeat(taken, number)
    start, end = spaces[first], spaces[first + k] + 1
    view = memoryview(data)
    digests = np.empty((len(start), 2), dtype="<u8")
    for i in range(0, len(start), 1 << 14):
        part = slice(i, i + (1 << 14))
        digests[part] = np.frombuffer(b"".join([xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(start[part].tolist(), end[part].tolist(), strict=True)]), dtype="<u8").reshape(-1, 2)
    owners = np.repeat(owner, number)
    order = np.lexsort((owners, digests[:, 0], digests[:, 1]))
    digests, owners = digests[order], owners[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (digests[1:] != digests[:-1]).any(axis=1)
    again = ~new
    again[1:] &= owners[1:] == owners[:-1]  # a window that one text has several times
    pairs = np.stack([np.cumsum(new) - 1, owners], axis=1)[~again]
    rep = order[new]
    return data, start[rep], (end - start)[rep], k[rep], pairs


def _blocks(data: np.ndarray, width: int) -> np.ndarray:
    """At each byte from `width` - 1 on, the last `width` bytes as a number."""
    out = np.zeros(len(data) - width + 1, dtype=np.uint64)
    for k in range(width):
        out = (out << np.uint64(8)) | data[k : len(data) - width + 1 + k]
    return out


def _slot(blocks: np.ndarray) -> np.ndarray:
    return ((blocks * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)


class _Tables:
    """Shift and suffix-hash tables over the heads (the first `reach` bytes) of patterns, which lie in `data` at `start`."""

    def __init__(self, data: bytes, start: np.ndarray, length: np.ndarray, rows: np.ndarray):
        self.start, self.length, self.rows = start, length, rows
        self.reach = int(length.min())
        self.width = max(2, min(8, self.reach // 3))
        self.shift = np.full(1 << _TABLE_BITS, self.reach - self.width + 1, dtype=np.int32)
        text, keep = np.frombuffer(data, dtype=np.uint8), np.uint64((1 << (8 * self.width)) - 1)
        block = np.zeros(len(start), dtype=np.uint64)
        for end in range(1, self.reach + 1):
            block = ((block << np.uint64(8)) | text[start + (end - 1)]) & keep
            if end >= self.width:
                self.shift[_slot(block)] = self.reach - end  # less each time, so the least stays
        self.bucket_rows = np.argsort(block, kind="stable")  # of the last block of each head
        self.bucket_keys, self.bucket_from = np.unique(block[self.bucket_rows], return_index=True)
        self.bucket_from = np.append(self.bucket_from, len(start))

    def search(self, patterns: bytes, data: bytes) -> Iterator[tuple[int, int]]:
        """(start, row of the window) of each occurrence of a pattern in `data`, in no order."""
        text = np.frombuffer(data, dtype=np.uint8)
        first, last = self.reach - 1, len(text) - 1  # places where a head can end
        if last < first:
            return
        blocks = _blocks(text, self.width)
        starts = np.arange(first, last + 1, _LANE_BYTES)
        at, stop = starts.copy(), np.minimum(starts + _LANE_BYTES, last + 1)
        while len(at):
            block = blocks[at - self.width + 1]
            skip = self.shift[_slot(block)]
            hit = np.flatnonzero(skip == 0)
            bucket = np.minimum(np.searchsorted(self.bucket_keys, block[hit]), len(self.bucket_keys) - 1)
            found = self.bucket_keys[bucket] == block[hit]
            for p, k in zip(at[hit[found]].tolist(), bucket[found].tolist(), strict=True):
                place = p - self.reach + 1
                for i in self.bucket_rows[self.bucket_from[k] : self.bucket_from[k + 1]].tolist():
                    a, n = int(self.start[i]), int(self.length[i])
                    if data[place : place + n] == patterns[a : a + n]:
                        yield place, int(self.rows[i])
            at += np.maximum(skip, 1)
            go = at < stop
            if not go.all():
                at, stop = at[go], stop[go]


class Matcher:
    """Finds windows in texts. Short windows have tables of their own, so that they do not shorten the shifts for the others.

    It is built once and sent to the workers: the items' text, and some 40 bytes for each distinct window."""

    def __init__(self, items: list[tuple[list, str | None]], size: int = WINDOW):
        """items: ids and text; equal texts once."""
        self.ids = [ids for ids, _ in items]
        self.data, start, length, self.words, self.pairs = _windows([words(t) for _, t in items], size)
        short = length < 32
        self.tables = [_Tables(self.data, start[x], length[x], np.flatnonzero(x)) for x in (~short, short) if x.any()]

    def items(self, window: int) -> Iterator[object]:
        """The ids of the items that have the window."""
        a, b = np.searchsorted(self.pairs[:, 0], [window, window + 1])
        for text in self.pairs[a:b, 1].tolist():
            yield from self.ids[text]

    def hits(self, texts: list[str | None]) -> list[tuple[int, list[tuple[int, int]], set]]:
        """For each text its words, the merged runs (from, to) of hit words and the items with occurring windows."""
        forms = [words(t) for t in texts]
        joined = [b" " + b" ".join(w) + b" " if w else b"" for w in forms]
        starts = np.cumsum([0] + [len(j) + 1 for j in joined])
        data = b"\n".join([*joined, b""])
        marks: dict[int, set[tuple[int, int]]] = {}
        windows: dict[int, set[int]] = {}
        for table in self.tables:
            for start, row in table.search(self.data, data):
                d = int(np.searchsorted(starts, start, "right")) - 1
                marks.setdefault(d, set()).add((start - int(starts[d]), int(self.words[row])))
                windows.setdefault(d, set()).add(row)
        out = []
        for d, w in enumerate(forms):
            if d not in marks:
                out.append((len(w), [], set()))
                continue
            spaces = np.flatnonzero(np.frombuffer(joined[d], dtype=np.uint8) == 32)
            runs: list[tuple[int, int]] = []
            for a, n in sorted((int(np.searchsorted(spaces, s)), n) for s, n in marks[d]):
                if runs and a <= runs[-1][1]:
                    runs[-1] = (runs[-1][0], max(runs[-1][1], a + n))
                else:
                    runs.append((a, a + n))
            out.append((len(w), runs, {i for row in windows[d] for i in self.items(row)}))
        return out


_HITS = "n_words long, runs array<struct<a:long,b:long>>, items array<string>"


def _search(rows: DataFrame, panel: DataFrame, size: int) -> DataFrame:
    """rows: _text and _row; panel: ids and t. The panel is of bounded size, so its tables, built here once, may go to every worker."""
    shared = rows.sparkSession.sparkContext.broadcast(Matcher([(sorted(r["ids"]), r["t"]) for r in panel.collect()], size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = shared.value
        for whole in batches:
            for batch in slices(whole, 0, 1 << 20):
                hits = matcher.hits(batch.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(1),
                        pa.array([n for n, _, _ in hits], pa.int64()),
                        pa.array([[{"a": a, "b": b} for a, b in runs] for _, runs, _ in hits], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))),
                        pa.array([sorted(map(str, items)) for _, _, items in hits], pa.list_(pa.string())),
                    ],
                    names=["_row", "n_words", "runs", "items"],
                )

    return rows.mapInArrow(run, f"_row {rows.schema['_row'].dataType.simpleString()}, {_HITS}")


def _digest(found: DataFrame) -> DataFrame:
    """Adds n_hit, n_items, items_sha256 and contaminated."""
    merged = F.aggregate(
        F.array_sort("runs"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("e")),
        lambda s, r: F.struct((s["n"] + F.greatest(F.lit(0).cast("long"), r["b"] - F.greatest(r["a"], s["e"]))).alias("n"), F.greatest(s["e"], r["b"]).alias("e")),
        lambda s: s["n"],
    )
    return found.select("_row.*", "n_words", merged.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"), (F.size("runs") > 0).alias("contaminated"))


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: list[str] | None = None, item_id: str = "item_id", item_text: str = "text", size: int = WINDOW, panel_bytes: int = PANEL_BYTES) -> DataFrame:
    """The columns `keep` of each document with n_words, n_hit, n_items, items_sha256 and contaminated.

    Null texts have no words; null items and items without words have no windows; items
    that share an id count once, and one without an id hits words but is not counted; an
    empty benchmark or table gives zero hits or no rows. A benchmark beyond `panel_bytes` is searched for in panels of
    about that size, whose findings are joined for each distinct row; below that, documents are scanned once and not shuffled.
    """
    keep = docs.columns if keep is None else keep
    kept = F.struct(*[F.col(f"`{c}`") for c in keep])
    items = benchmark.where(F.col(item_text).isNotNull()).groupBy(F.col(item_text).alias("t")).agg(F.collect_set(F.col(item_id).cast("string")).alias("ids"))
    bytes_ = items.agg(F.coalesce(F.sum(F.octet_length("t") + 64), F.lit(0))).first()[0]
    panels = max(1, -(-int(bytes_) // panel_bytes))
    if panels == 1:
        return _digest(_search(docs.select(F.col(text).alias("_text"), kept.alias("_row")), items, size))
    tables = Scratch(docs.sparkSession, "decontaminate")
    rows = docs.select(F.col(text).alias("_text"), F.struct(F.col(text).alias("t"), text_key(text).alias("k"), kept.alias("r")).alias("_row"))
    light = rows.select("_text", F.struct(F.xxhash64("_row.r", "_row.k").alias("h"), F.xxhash64(F.lit(7), "_row.r", "_row.k").alias("g")).alias("_row"))
    parts = []
    for p in range(panels):
        part = _search(light, items.where(F.pmod(F.xxhash64("t"), F.lit(panels)) == p), size).where(F.size("runs") > 0)
        parts.append(tables.table(part.select("_row.h", "_row.g", "runs", "items").distinct(), f"panel{p}"))
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionByName(part)
    hits = hits.groupBy("h", "g").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    n_words = F.size(F.filter(F.split(F.translate(F.coalesce("_text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")).cast("long")
    counted = rows.select(F.xxhash64("_row.r", "_row.k").alias("h"), F.xxhash64(F.lit(7), "_row.r", "_row.k").alias("g"), n_words.alias("n_words"), F.col("_row.r").alias("_row"))
    none = F.array().cast("array<struct<a:bigint,b:bigint>>")
    joined = counted.join(hits, ["h", "g"], "left").select("_row", "n_words", F.coalesce("runs", none).alias("runs"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return _digest(joined)


def brute(texts: list[str | None], items: list[tuple[object, str | None]], size: int = WINDOW) -> list[tuple[int, int, int, str, bool]]:
    """What scan() finds, by looking each window up at each word; for tests."""
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: [] if t is None else pattern.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
    wins = {tuple(w[i : i + size]): set() for _, t in items if (w := split(t)) for i in range(max(1, len(w) - size + 1))}
    for item, t in items:
        w = split(t)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            wins[tuple(w[i : i + size])].add(str(item))
    out = []
    for t in texts:
        w, hit, ids = split(t), set(), set()
        for k, who in wins.items():
            for i in range(len(w) - len(k) + 1):
                if tuple(w[i : i + len(k)]) == k:
                    hit.update(range(i, i + len(k)))
                    ids |= who
        out.append((len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out
