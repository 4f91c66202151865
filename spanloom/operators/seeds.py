"""Local alignment of many queries to stretches of the reference: a seed index says where to look, the kernel looks only there.

Seeds are minimizers, the least hashed words of K letters in windows of W words. Two texts that share a run of K + W - 1 letters
share a seed. So an alignment without a shared seed has a gap or a mismatch in every run of that length, which bounds its score;
where seeds lead to a better one, it is the best there is. The other queries are aligned to their whole stretch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.align import DEFAULT, Scoring, encode, gaps_may_pay, letter_codes, locate, locate_many, locate_ungapped
from spanloom.operators.reference import with_reference

#: Letters of a seed (12 fit in 24 bits), seeds of a window, diagonals that are looked at together, letters around them.
K, W, DIAGONALS, SLACK = 12, 8, 32, 40


def minimizers(text: str, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """Places and codes of the text's seeds; words with other letters than A, C, G and T are none."""
    codes = encode(text).astype(np.int64)
    n = len(codes) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    word = np.zeros(n, dtype=np.int64)
    for i in range(k):
        word = word << 2 | (codes[i : i + n] & 3)
    bad = np.concatenate([[0], np.cumsum(codes > 3)])
    order = (word.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(8)).astype(np.int64)
    order[bad[k:] != bad[:-k]] = np.iinfo(np.int64).max
    width = min(w, n)
    best = np.lib.stride_tricks.sliding_window_view(order, width).argmin(axis=1) + np.arange(n - width + 1)
    at = np.unique(best)
    at = at[order[at] != np.iinfo(np.int64).max]
    return at, word[at]


def seed_index(reference: DataFrame, chunk: int, k: int = K, w: int = W) -> DataFrame:
    """reference: contig, chunk_id, chunk. For each seed of a chunk, which goes on into the next one for as long as a window does:
    contig, chunk_id, at (on the contig), seed."""
    head = reference.select("contig", (F.col("chunk_id") - 1).alias("chunk_id"), F.left("chunk", F.lit(k + w - 2)).alias("__next"))
    rows = reference.join(head, ["contig", "chunk_id"], "left").select("contig", "chunk_id", F.concat("chunk", F.coalesce("__next", F.lit(""))).alias("t"), F.length("chunk").alias("n"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                at, seed = minimizers(r.t, k, w)
                inside = at < r.n
                yield pd.DataFrame({"contig": r.contig, "chunk_id": r.chunk_id, "at": at[inside] + r.chunk_id * chunk, "seed": seed[inside]})

    return rows.mapInPandas(run, f"contig {kinds['contig']}, chunk_id long, at long, seed long").distinct()


def _query_seeds(queries: DataFrame, key: list[str], k: int, w: int) -> DataFrame:
    """key, q. key, at and seed of each seed."""
    rows = queries.where("q is not null").select(F.struct(*key).alias("key"), "q")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keys, places, seeds = [], [], []
            for key_, q in zip(frame["key"], frame["q"], strict=True):
                at, seed = minimizers(q, k, w)
                keys += [key_] * len(at)
                places.append(at)
                seeds.append(seed)
            if keys:
                yield pd.DataFrame({"key": keys, "qat": np.concatenate(places), "seed": np.concatenate(seeds)})

    return rows.mapInPandas(run, f"key {rows.schema['key'].dataType.simpleString()}, qat long, seed long").select("key.*", "qat", "seed")


def _sure(n: int, scoring: Scoring, k: int, w: int) -> int:
    """What no alignment of n letters outside the seeds' windows can exceed."""
    run, least = k + w - 2, min(scoring.mismatch, scoring.gap_open)
    unseeded = max(scoring.match * min(n, run), scoring.match * n - least * (-(-n // run) - 1))
    far = scoring.match * n - scoring.gap_open - SLACK * scoring.gap_extend
    return max(unseeded, far)


def locate_by_seeds(queries: list[str], bins: list[list[int]], text: str, scoring: Scoring, k: int = K, w: int = W) -> list[tuple[int, int, int, int, int] | None]:
    """locate() of each query in the text; bins: the groups of diagonals on which the query shares a seed with it."""
    out: list[tuple[int, int, int, int, int] | None] = [None] * len(queries)
    rest = []
    for i, q in enumerate(queries):
        best, spans = None, []
        for b in sorted(bins[i]):
            low, high = max(0, b * DIAGONALS - SLACK), (b + 1) * DIAGONALS + len(q) + SLACK
            if spans and low < spans[-1][1]:  # windows that overlap are looked at as one
                spans[-1] = (spans[-1][0], high)
            else:
                spans.append((low, high))
        for low, high in spans if sum(high - low for low, high in spans) < len(text) else []:
            found = locate(q, text[low:high], scoring)
            if found is not None and (best is None or found[0] > best[0]):
                best = (found[0], found[1] + low, found[2] + low, *found[3:])
        if best is not None and best[0] > _sure(len(q), scoring, k, w):
            out[i] = best
        else:
            rest.append(i)
    for i, found in zip(rest, locate_many([queries[i] for i in rest], text, scoring), strict=True):
        out[i] = found
    return out


def _codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The letters of all texts end to end as codes, and where each begins, and the end of all."""
    texts = texts.cast(pa.large_string())
    starts = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8)[starts[0] : starts[-1]] if data is not None else np.empty(0, dtype=np.uint8)
    if len(data) and data.max() > 127:  # one letter that is none of the four, as encode() has it
        return _codes(pc.replace_substring_regex(texts, "[^\\x00-\\x7F]", "?"))
    return letter_codes(data), starts - starts[0]


def align_to_stretches(stretches: DataFrame, queries: DataFrame, group: list[str], key: list[str], reference: DataFrame, index: DataFrame | None, chunk: int, scoring: Scoring = DEFAULT, k: int = K, w: int = W) -> DataFrame:
    """stretches: group, contig, low, high (half-open); queries: group, key, q, and any other columns. Adds to the queries that align
    at all score, start, end (inclusive, on the contig), left_clip and right_clip (letters of the query that do not).

    A stretch's text is fetched once for all its queries, which are one row with it: the reads of one cluster, of which there are
    a thousand at most. Seeds are joined with the index by contig, chunk and seed. Queries too short for a gap to pay need no seeds:
    those of many stretches go along the diagonals of their whole stretch together. Without an index no query has seeds."""
    both = [*group, *key]
    queries = queries.where("q is not null")
    row, bins = F.struct(*[c for c in queries.columns if c not in group]).alias("row"), F.array().cast("array<bigint>")
    if index is not None:
        chunks = stretches.where("high > low").select(*group, "contig", "low", "high", F.explode(F.sequence(F.expr(f"greatest(low, 0) div {chunk}"), F.expr(f"(greatest(high, 1) - 1) div {chunk}"))).alias("chunk_id"))
        long = queries.where(gaps_may_pay(F.length("q"), scoring))
        hits = _query_seeds(long, both, k, w).join(chunks, group).join(index, ["contig", "chunk_id", "seed"]).where(f"at >= low and at + {k} <= high")
        found = hits.groupBy(*both).agg(F.collect_set(F.floor((F.col("at") - F.greatest("low", F.lit(0)) - F.col("qat")) / DIAGONALS)).alias("__bins"))
        # Rows of a query may repeat; each is aligned.
        queries, bins = queries.join(found, both, "left"), F.coalesce("__bins", bins)
    lists = queries.groupBy(*group).agg(F.collect_list(F.struct(row, bins.alias("bins"))).alias("__queries"))
    texts = with_reference(stretches.where("high > low"), reference, group, "contig", "low", "high", "__text", chunk)
    work = texts.join(lists, group).select(F.struct(*group).alias("group"), F.greatest("low", F.lit(0)).cast("long").alias("low"), F.col("__text").alias("text"), F.col("__queries").alias("queries"))
    work = work.repartition(int(work.sparkSession.conf.get("spark.sql.shuffle.partitions")), "group")  # few bytes, but much work
    kind = work.schema["queries"].dataType.elementType["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            lists = batch.column("queries")
            of, entries = lists.value_parent_indices().to_numpy(), lists.flatten()
            rows = entries.field("row")
            letters, starts = _codes(rows.field("q"))
            texts, text_starts = _codes(batch.column("text"))
            found, sizes = np.zeros((len(rows), 5), dtype=np.int64), np.diff(starts)
            long = gaps_may_pay(sizes, scoring)
            found[~long] = locate_ungapped(letters, starts, texts, text_starts, of, scoring, np.flatnonzero(~long))
            for i in np.unique(of[long]).tolist():
                some = np.flatnonzero(long & (of == i))
                places = locate_by_seeds(rows.field("q").take(pa.array(some)).to_pylist(), entries.field("bins").take(pa.array(some)).to_pylist(), batch.column("text")[i].as_py(), scoring, k, w)
                found[some] = [(0, 0, 0, 0, 0) if p is None else p for p in places]
            some = np.flatnonzero(found[:, 0] > 0)
            score, begin, end, first, last = found[some].T
            low = batch.column("low").to_numpy()[of[some]]
            numbers = {"score": score.astype(np.int32), "start": low + begin, "end": low + end, "left_clip": first.astype(np.int32), "right_clip": (sizes[some] - 1 - last).astype(np.int32)}
            yield pa.RecordBatch.from_pydict({"group": batch.column("group").take(pa.array(of[some])), "row": rows.take(pa.array(some))} | {c: pa.array(v) for c, v in numbers.items()})

    done = work.mapInArrow(run, f"group {work.schema['group'].dataType.simpleString()}, row {kind}, score int, start long, end long, left_clip int, right_clip int")
    return done.select("group.*", "row.*", "score", "start", "end", "left_clip", "right_clip")
