"""Exact top-k search by distributed histogram selection.

Every candidate is scored against every query. For each query global histograms of the scores locate its kth best value: a
first one spans all possible scores, each next one only the bin that holds the kth value, until that bin is one value or
holds few rows. Then candidates from that value on are kept, and ties go to smaller ids.

A task sends, for each query, only its own best bins down to where its own kth score lies (the global one cannot lie lower),
so a histogram takes k rows a task and query at most; and in the end its own k best rows at most.

Queries are taken in panels of bounded size, which go to every task.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import Scratch

K, SCALE = 10, 1024
BINS = 1024
#: Queries for each panel, on average (they are dealt out by a hash of ids and vectors).
PANEL = 2048
#: A query's bin is not refined further once no more rows than so many times k reach it.
FEW = 16
_ROWS = 2048
_EXACT = 1 << 53


def quantise(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """rows: id, v (array of float or double), q. Keeps id, d (length), v (floor(scale * x), whole numbers packed as doubles) and q.

    Rows whose id or vector is null, or whose vector holds a null or non-finite component (or one that scaling makes so), take
    no part. An empty vector does, with other empty ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors, wanted = batch.column(0), batch.column(1), batch.column(2)
            keep, packed, sizes = [], [], []
            lengths = np.asarray(pc.fill_null(pc.list_value_length(vectors), 0))
            flat = vectors.flatten()
            nulls = np.asarray(pc.is_null(flat))
            data = np.floor(np.asarray(pc.fill_null(flat, float("nan")).cast(pa.float64())) * float(scale))
            bad = np.concatenate([[0], np.cumsum(nulls | ~np.isfinite(data))])
            ends = np.cumsum(lengths)
            none = np.asarray(pc.or_(pc.is_null(ids), pc.is_null(vectors)))
            for i, (end, n) in enumerate(zip(ends.tolist(), lengths.tolist(), strict=True)):
                if not none[i] and bad[end] == bad[end - n]:
                    keep.append(i)
                    packed.append(data[end - n : end].astype("<f8").tobytes())
                    sizes.append(n)
            rows_ = pa.array(keep, pa.int32())
            yield pa.RecordBatch.from_arrays([ids.take(rows_), pa.array(sizes, pa.int32()), pa.array(packed, pa.binary()), wanted.take(rows_)], names=["id", "d", "v", "q"])

    return rows.mapInArrow(run, "id long, d int, v binary, q boolean")


class _Panel:
    """Queries by length of their vectors, and for each the values from low to top, in bins of a width, that hold its kth score."""

    def __init__(self, queries: list[tuple[int, int, bytes]], k: int, bins: int, norms: dict[int, float]):
        self.k, self.bins = k, bins
        self.ids = np.array([q[0] for q in queries], dtype=np.int64)
        self.groups: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.low = np.zeros(len(queries), dtype=np.int64)
        self.top = np.full(len(queries), (1 << 63) - 1, dtype=np.int64)  # rows beyond it are counted already
        self.width = np.ones(len(queries), dtype=np.int64)
        self.need = np.full(len(queries), k, dtype=np.int64)
        self.open = np.ones(len(queries), dtype=bool)
        for d in sorted({q[1] for q in queries}):
            at = np.array([i for i, q in enumerate(queries) if q[1] == d])
            self.groups[d] = (at, np.stack([np.frombuffer(queries[i][2], dtype="<f8") for i in at]))
            for i, row in zip(at, self.groups[d][1], strict=True):
                reach = int(min(_norm(row) * norms.get(d, 0.0) * 1.0001, 2.0**62)) + 1 if d else 1
                reach = (1 << 63) - 1 if reach > 1 << 62 else reach
                self.low[i] = -reach
                self.width[i] = max(1, -(-2 * reach // bins) + 1)

    def refine(self, found: list[tuple[int, int, int, int]]) -> None:
        """found: query, bin with the kth score, rows in better bins and in this one, for the open queries that have k rows or more."""
        for q, b, _, _ in found:
            self.low[q] = min(int(self.low[q]) + b * int(self.width[q]), (1 << 63) - 1)
            self.top[q] = min(int(self.low[q]) + int(self.width[q]) - 1, int(self.top[q]))
        held = {q: (better, n) for q, _, better, n in found}
        for q in np.flatnonzero(self.open).tolist():
            if q not in held:  # fewer than k candidates: all of them are wanted
                self.low[q], self.open[q] = -(1 << 63), False
                continue
            better, n = held[q]
            self.need[q] -= better
            self.open[q] = self.width[q] > 1 and self.k - self.need[q] + n > FEW * self.k
            if self.open[q]:
                self.width[q] = -(-int(self.width[q]) // self.bins)


def _scores(batch: pa.RecordBatch, panel: _Panel) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of queries, ids of candidates and their scores (a row for each candidate)."""
    ids, sizes, packed = np.asarray(batch.column(0)), np.asarray(batch.column(1)), batch.column(2).to_pylist()
    for d, (at, matrix) in panel.groups.items():
        mine = np.flatnonzero(sizes == d)
        for start in range(0, len(mine), _ROWS):
            part = mine[start : start + _ROWS]
            x = np.frombuffer(b"".join([packed[i] for i in part]), dtype="<f8").reshape(len(part), d)
            yield at, ids[part], _products(x, matrix)


def _products(x: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers; those beyond 64 bits count as the nearest 64-bit number."""
    if float(np.abs(x).max(initial=0)) * float(np.abs(matrix).max(initial=0)) * x.shape[1] < _EXACT:
        return (x @ matrix.T).astype(np.int64)
    exact = [[sum(map(operator.mul, a, b)) for b in matrix_rows] for matrix_rows in [[list(map(int, r)) for r in matrix.tolist()]] for a in [list(map(int, r)) for r in x.tolist()]]
    return np.array([[max(-(1 << 63), min((1 << 63) - 1, v)) for v in row] for row in exact], dtype=np.int64).reshape(len(x), len(matrix))


def _norm(x: np.ndarray) -> float:
    """The Euclidean norm, infinite where squares overflow."""
    with np.errstate(over="ignore"):
        return float(np.sqrt((x * x).sum()))


def _histogram(codes: DataFrame, panel: _Panel) -> list[tuple[int, int, int, int]]:
    """For each open query the bin of its kth score and how many rows are in better bins and in it; one row a query reaches the driver."""
    shared = codes.sparkSession.sparkContext.broadcast(panel)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        counts = np.zeros((len(p.ids), p.bins), dtype=np.int64)
        for batch in batches:
            for at, ids, scores in _scores(batch, p):
                live = p.open[at]
                at, scores = at[live], scores[:, live]
                inside = (scores >= p.low[at]) & (scores <= p.top[at]) & (ids[:, None] != p.ids[at])
                above = np.ascontiguousarray(scores).view(np.uint64) - p.low[at].view(np.uint64)  # right also where a signed difference overflows
                bin_ = above // p.width[at].view(np.uint64)
                inside &= bin_ < np.uint64(p.bins)
                bin_ = np.where(inside, bin_, 0).astype(np.int64)
                row = np.broadcast_to(at, scores.shape)
                counts += np.bincount((row[inside] * p.bins + bin_[inside]), minlength=counts.size).reshape(counts.shape)
        best = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1]  # rows in this bin or better ones
        q, b = np.nonzero((counts > 0) & (best - counts < p.need[:, None]))
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(counts[q, b])], names=["query", "bin", "n"])

    spark_bins = codes.mapInArrow(run, "query int, bin int, n long").groupBy("query", "bin").agg(F.sum("n").alias("n"))
    needs = dict(enumerate(panel.need.tolist()))
    by_query = spark_bins.groupBy("query").agg(F.collect_list(F.struct("bin", "n")).alias("bins"))  # `bins` entries at most

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for q, bins in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total = 0
                for entry in sorted(bins, key=lambda e: -e["bin"]):
                    if total + entry["n"] >= needs[q]:
                        out.append((q, entry["bin"], total, entry["n"]))
                        break
                    total += entry["n"]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.int64()))], names=["query", "bin", "better", "n"])

    return [(r["query"], r["bin"], r["better"], r["n"]) for r in by_query.mapInArrow(pick, "query int, bin int, better long, n long").collect()]


def _best(codes: DataFrame, panel: _Panel) -> DataFrame:
    """number, query_id, rank, id, score: candidates from each query's located value on, by score, then by id."""
    shared = codes.sparkSession.sparkContext.broadcast(panel)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        held = [np.empty(0, dtype=np.int64)] * 3  # query, id, score: the task's k best of each query

        def cut(parts: list[np.ndarray]) -> list[np.ndarray]:
            q, i, s = parts
            order = np.lexsort((i, ~s, q))  # ~s falls as s grows, without overflow
            q, i, s = q[order], i[order], s[order]
            start = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.empty(0, dtype=np.int64)
            place = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
            return [x[place < p.k] for x in (q, i, s)]

        for batch in batches:
            for at, ids, scores in _scores(batch, p):
                r, c = np.nonzero((scores >= p.low[at]) & (ids[:, None] != p.ids[at]))
                held = cut([np.concatenate([held[0], at[c]]), np.concatenate([held[1], ids[r]]), np.concatenate([held[2], scores[r, c]])])
        yield pa.RecordBatch.from_arrays([pa.array(held[0].astype(np.int32)), pa.array(p.ids[held[0]]), pa.array(held[1]), pa.array(held[2])], names=["number", "query_id", "id", "score"])

    found = codes.mapInArrow(run, "number int, query_id long, id long, score long")
    place = F.row_number().over(Window.partitionBy("number", "query_id").orderBy(F.desc("score"), "id"))  # k rows a task and query at most
    return found.withColumn("rank", place).where(F.col("rank") <= panel.k).select("query_id", "rank", "id", "score")


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector: str = "embedding", k: int = K, scale: int = SCALE, bins: int = BINS, panel_size: int = PANEL) -> DataFrame:
    """For each row that is a query, its k best other rows by integer inner product: query_id, rank, id_col, score.

    Queries are compared with rows of the same vector length and another id; with fewer than k such rows all are returned.
    Rows that repeat as candidates are candidates each; queries that agree on id and vector count once. Null or unusable
    vectors take no part (see quantise); an empty table gives no rows. Other columns are not read.
    """
    tables = Scratch(vectors.sparkSession, "topk")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    codes = tables.table(quantise(rows, scale), "codes")
    queries = codes.where("q").select("id", "d", "v").distinct()
    panels = max(1, -(-queries.count() // panel_size))
    norms = _norms(codes)
    results = []
    for number in range(panels):
        mine = [(r["id"], r["d"], bytes(r["v"])) for r in queries.where(F.pmod(F.xxhash64("id", "v"), F.lit(panels)) == number).collect()]
        if not mine:
            continue
        panel = _Panel(sorted(mine), k, bins, norms)
        while panel.open.any():
            panel.refine(_histogram(codes.select("id", "d", "v"), panel))
        results.append(tables.table(_best(codes.select("id", "d", "v"), panel).withColumnRenamed("id", id_col), f"panel{number}"))
    if not results:
        return vectors.sparkSession.createDataFrame([], f"query_id long, rank int, {id_col} long, score long")
    out = results[0]
    for part in results[1:]:
        out = out.unionByName(part)
    return out


def _norms(codes: DataFrame) -> dict[int, float]:
    """The largest norm among the vectors of each length; the driver gets a row for each length and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most: dict[int, float] = {}
        for batch in batches:
            for d, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                most[d] = max(most.get(d, 0.0), _norm(np.frombuffer(v, dtype="<f8")))
        yield pa.RecordBatch.from_arrays([pa.array(most.keys(), pa.int32()), pa.array(most.values(), pa.float64())], names=["d", "m"])

    return {r["d"]: r["m"] for r in codes.select("d", "v").mapInArrow(run, "d int, m double").groupBy("d").agg(F.max("m").alias("m")).collect()}
