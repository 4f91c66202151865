"""Removal of repeated passages: runs of consecutive units (lines or sentences) that occur anywhere before.

Every run is hashed; runs whose hash occurs twice are found globally; of the occurrences of a run all but the first, in the
order of (id, text hash, position), are removed by merging the units that they cover.

Two passes over the texts keep what is shuffled small: the first sends 8 bytes for each run and counts them; the second
sends places only of runs that pass a filter of fixed size made from the hashes that repeat. 128 bits of hash are compared
before anything is removed.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import KeyFilter, Scratch, slices, text_key

#: A sentence ends with a run of full stops, exclamation or question marks, or before a line's end.
_SENTENCE = re.compile(r"[^.!?\n]*[.!?]+|[^.!?\n]+|\n")
#: What is trimmed off a unit, and collapsed within a sentence, before hashing.
_BLANK = " \t\r\f\v"
LINES_PER_WINDOW = 3
#: A run of sentences counts from so many sentences and words on.
LEAST_SENTENCES, LEAST_WORDS = 2, 16


@dataclass(frozen=True)
class Rule:
    """pieces: all parts of a text in order; key: what is compared of a part, empty for parts that are not units; glue: what
    joins the parts again; runs: the (first, last) units of each run."""

    pieces: Callable[[str], list[str]]
    key: Callable[[str], str]
    glue: str
    runs: Callable[[list[str]], list[tuple[int, int]]]

    def units(self, text: str | None) -> tuple[list[str], list[str]]:
        """The parts and their keys."""
        parts = self.pieces(text) if text else []
        return parts, [self.key(p) for p in parts]

    def hashes(self, keys: list[str]) -> tuple[list[int], list[tuple[int, int]]]:
        """128-bit hashes of the runs of these units (none of them empty), and the runs."""
        data = [k.encode("utf-8", "replace") for k in keys]
        runs = self.runs(keys)
        return [xxhash.xxh3_128_intdigest(b"\n".join(data[a : b + 1])) for a, b in runs], runs


def _line_windows(size: int) -> Callable[[list[str]], list[tuple[int, int]]]:
    return lambda keys: [(i, i + size - 1) for i in range(len(keys) - size + 1)]


def _sentence_runs(sentences: int, words: int) -> Callable[[list[str]], list[tuple[int, int]]]:
    """From each sentence the shortest run onward, and to each sentence the shortest run up to it, that is long enough in
    sentences and words. So a repeated passage that is long enough is covered up to both of its ends."""

    def runs(keys: list[str]) -> list[tuple[int, int]]:
        n = len(keys)
        total = [0]
        for k in keys:
            total.append(total[-1] + k.count(" ") + 1)
        found, end = set(), 0
        for start in range(n):  # the shortest end never moves back
            end = max(end, start + sentences)
            while end <= n and total[end] - total[start] < words:
                end += 1
            if end > n:
                break
            found.add((start, end - 1))
        start = n
        for end in range(n, 0, -1):
            start = min(start, end - sentences)
            while start >= 0 and total[end] - total[start] < words:
                start -= 1
            if start < 0:
                break
            found.add((start, end - 1))
        return sorted(found)

    return runs


def line_rule(size: int = LINES_PER_WINDOW) -> Rule:
    """Windows of lines; lines of white space only are no units and stay."""
    return Rule(lambda t: t.split("\n"), lambda p: p.strip(_BLANK), "\n", _line_windows(size))


def sentence_rule(sentences: int = LEAST_SENTENCES, words: int = LEAST_WORDS) -> Rule:
    collapse = re.compile(f"[{_BLANK}]+")
    return Rule(_SENTENCE.findall, lambda p: "" if p == "\n" else collapse.sub(" ", p).strip(" "), "", _sentence_runs(sentences, words))


_PLACE = "h1 long, h2 long, id {id}, tk long, a int, b int"


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _first_hashes(docs: DataFrame, rule: Rule) -> DataFrame:
    """docs: t. The upper 8 bytes of each run's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 0):
                out: list[int] = []
                for text in batch.column(0).to_pylist():
                    out += [h >> 64 for h in rule.hashes([k for k in rule.units(text)[1] if k])[0]]
                yield pa.RecordBatch.from_arrays([pa.array(np.array(out, dtype=np.uint64).view(np.int64))], names=["h1"])

    return docs.select("t").mapInArrow(run, "h1 long")


def _places(docs: DataFrame, rule: Rule, only: KeyFilter) -> DataFrame:
    """docs: t, id, tk. The runs that pass the filter."""
    shared = docs.sparkSession.sparkContext.broadcast(only)
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = shared.value.has
        for whole in batches:
            for batch in slices(whole, 0):
                hashes, row, spans = [], [], []
                for i, text in enumerate(batch.column(0).to_pylist()):
                    h, r = rule.hashes([k for k in rule.units(text)[1] if k])
                    hashes += h
                    spans += r
                    row += [i] * len(h)
                h1 = np.array([h >> 64 for h in hashes], dtype=np.uint64).view(np.int64)
                at = np.flatnonzero(passes(h1))
                rows = pa.array([row[i] for i in at], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(h1[at]),
                        pa.array([_signed(hashes[i] & ((1 << 64) - 1)) for i in at], pa.int64()),
                        batch.column(1).take(rows),
                        batch.column(2).take(rows),
                        pa.array([spans[i][0] for i in at], pa.int32()),
                        pa.array([spans[i][1] for i in at], pa.int32()),
                    ],
                    names=["h1", "h2", "id", "tk", "a", "b"],
                )

    return docs.select("t", "id", "tk").mapInArrow(run, _PLACE.format(id=id_type))


def remove_repeats(docs: DataFrame, rule: Rule, text: str = "text", id_col: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` with `text` cleaned, n_units and n_removed.

    A null text stays null and an empty one empty, with 0 units. A text whose units all go becomes empty. Rows that agree on
    id and text count as one document and get the same result; rows that share an id only are told apart by their texts'
    hash. A null id comes before all others. Columns other than `keep`, the id and the text are not read.
    """
    keep = docs.columns if keep is None else keep
    tables = Scratch(docs.sparkSession, "repeats")
    rows = docs.select(F.col(text).alias("t"), F.col(id_col).alias("id"), text_key(text).alias("tk"))
    some = rows.where(F.col("t").isNotNull())
    repeated = tables.table(_first_hashes(some, rule).groupBy("h1").agg(F.count("*").alias("n")).where("n > 1").select("h1"), "repeated")
    places = tables.table(_places(some, rule, KeyFilter.build(repeated, "h1")), "places")
    first = tables.table(places.groupBy("h1", "h2").agg(F.min(F.struct("id", "tk", "a", "b")).alias("first"), F.count("*").alias("n")).where("n > 1").select("h1", "h2", "first"), "first")
    later = places.join(first, ["h1", "h2"]).where(F.struct("id", "tk", "a", "b") > F.col("first"))
    removed = tables.table(later.groupBy("id", "tk").agg(F.collect_set(F.struct("a", "b")).alias("runs")), "removed")
    tables.drop("repeated", "places", "first")

    whole = docs.select(F.col(text).alias("t"), F.col(id_col).alias("id"), text_key(text).alias("tk"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"))
    joined = whole.join(removed.withColumnsRenamed({"id": "rid", "tk": "rtk"}).hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("rid")) & (F.col("tk") == F.col("rtk")), "left")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices(big, 0):
                texts, counts, gone = [], [], []
                for t, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    parts, keys = rule.units(t)
                    covered = {u for r in runs or () for u in range(r["a"], r["b"] + 1)}
                    counts.append(sum(map(bool, keys)))
                    gone.append(len(covered))
                    if covered:
                        kept, unit = [], -1
                        for part, key in zip(parts, keys, strict=True):
                            unit += bool(key)
                            if not key or unit not in covered:
                                kept.append(part)
                        t = rule.glue.join(kept)
                    texts.append(t)
                yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(gone, pa.int64())], names=["row", "clean", "n_units", "n_removed"])

    schema = f"row {joined.schema['row'].dataType.simpleString()}, clean string, n_units long, n_removed long"
    out = joined.select("t", "runs", "row").mapInArrow(clean, schema)
    return out.select(*[F.col(f"row.`{c}`") for c in keep if c != text], F.col("clean").alias(text), "n_units", "n_removed")
