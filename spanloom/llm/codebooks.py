"""Vector code compression: codebooks for consecutive parts of vectors, fitted by Lloyd's rounds over heaps of slack.

A part stays with its entry as long as its distance to it (the upper bound) cannot have passed its distance to the next best one
(the lower bound). Both drift as entries move, by the same amounts for all parts of an entry; so an entry keeps a heap of its
parts by lower minus upper bound, shifted by the drift there was when the bound was taken. A round pops only parts whose slack
the drift since then may have used up, measures these against all entries exactly, and pushes them again where they belong.

Heaps lie in blocks of rows inside a partition. They are kept as bytes from round to round in a table of the shared folder, so a
lost executor costs the tasks of one round. What leaves a task are changes of the entries' sums; what all tasks get are codebooks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import Scratch

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows of a block; rows measured against a codebook at a time; bytes of a row group of blocks.
BLOCK, _ROWS, _GROUP = 4096, 1024, 8 << 20
#: Tables of up to so many labels are sent to every task; larger ones are joined by shuffling.
FEW_LABELS = 100_000
#: Bounds are taken as tighter than they are by this share, as square roots are not exact.
_CAUTION = 1e-9


def compress(rows: DataFrame, row_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """For each row: the id, code (two hex digits for each part), error (squared distance to the coded vector), label_error (summed
    over rows of the same label, null as one label), codebooks_sha256 (of all components of all entries), and label.

    Components become floor(scale * x). Rows take no part, and have no row in the result, whose vector is null or holds a null or
    non-finite component. Vectors shorter than the longest one, whose length is rounded up to a multiple of `parts`, are filled
    up with zeros; an empty vector is all zeros. Components beyond what 64 bits bear in a squared distance (2**28 for parts of 16)
    count as that bound, and sums beyond 64 bits as the largest number. Entries start as the parts of the rows with the smallest ids
    (null ids last, ties by vector), as many as there are if fewer than `entries`; equal entries and equal distances fall to the
    lower index. Rows with the same id are rows of their own. An empty table gives none.
    """
    if entries > 256:
        raise ValueError("two hex digits hold 256 entries at most")
    tables = Scratch(rows.sparkSession, "codebooks")
    sound = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = rows.where(F.col(vector).isNotNull() & sound).select(F.col(row_id).alias("id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    longest = kept.agg(F.max(F.size("v"))).first()[0] or 0
    width = -(-longest // parts)
    most = (1 << ((62 - (max(width, 1) - 1).bit_length()) // 2 - 1)) - 1
    ready = kept.select("id", "label", F.transform("v", lambda x: _whole(x, scale, most)).alias("v"))
    first = ready.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    seeds = np.zeros((len(first), parts * width), dtype=np.int64)
    for i, r in enumerate(first):
        seeds[i, : len(r["v"])] = r["v"]
    books = np.ascontiguousarray(seeds.reshape(len(first), parts, width).transpose(1, 0, 2))
    drift = np.zeros(books.shape[:2])
    sums, counts = np.zeros_like(books), np.zeros(books.shape[:2], dtype=np.int64)
    state, spark = ready, rows.sparkSession
    for r in range(rounds if first else 0):
        step = _packed(state, books, block) if r == 0 else _moved(state, books, drift)
        step.write.mode("overwrite").option("parquet.block.size", _GROUP).parquet(tables.path(f"round{r}"))
        if r:
            tables.drop(f"round{r - 1}")
        state = spark.read.schema(step.schema).parquet(tables.path(f"round{r}"))
        for p, e, n, values in _changes(state, books.shape):
            counts[p, e] += n
            sums[p, e] += np.array(values, dtype=np.int64)
        used = counts > 0
        fresh = np.where(used[:, :, None], sums // np.maximum(counts, 1)[:, :, None], books)  # // rounds down
        drift = drift + _drifts(books, fresh)
        books = fresh
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = tables.table(_coded(state, books, drift) if first else _nothing(ready), "codes")
    largest = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    totals = tables.table(coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(20,0)")).cast("decimal(38,0)"), largest).cast("long").alias("label_error")), "totals")
    if totals.count() <= FEW_LABELS:
        totals = F.broadcast(totals)
    joined = coded.join(totals.withColumnRenamed("label", "of"), F.col("label").eqNullSafe(F.col("of")))
    return joined.select(F.col("id").alias(row_id), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"), F.col("label").alias(label if label != row_id else "label"))


def _whole(x: Column, scale: int, most: int) -> Column:
    return F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(float(-most))), F.lit(float(most)))).cast("int")


def _nothing(ready: DataFrame) -> DataFrame:
    return ready.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).limit(0)


def _drifts(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """By part and entry, how much the slack of the entry's parts may shrink: its own move and the largest one of all others."""
    moves = np.sqrt(((new - old).astype(np.float64) ** 2).sum(axis=2))
    others = np.zeros_like(moves)
    if moves.shape[1] > 1:
        ranked = np.sort(moves, axis=1)
        others = np.where(np.arange(moves.shape[1]) == moves.argmax(axis=1)[:, None], ranked[:, -2:-1], ranked[:, -1:])
    return (moves + others) * (1 + _CAUTION)


def _measure(vectors: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each vector the nearest entry (the first of equals), its squared distance and that of the next best one, exactly."""
    n = len(vectors)
    best, d1, d2 = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64), np.full(n, -1, dtype=np.int64)
    reach = (int(np.abs(vectors).max(initial=0)) + int(np.abs(book).max(initial=0))) ** 2 * max(book.shape[1], 1)
    kind = np.float64 if reach < 1 << 52 else np.int64  # whole numbers that floats hold go through the faster product
    b = book.astype(kind)
    squares = (b * b).sum(axis=1)
    for i in range(0, n, _ROWS):
        v = vectors[i : i + _ROWS].astype(kind)
        d = (v * v).sum(axis=1)[:, None] - 2 * (v @ b.T) + squares
        at = d.argmin(axis=1)
        rows = np.arange(len(v))
        best[i : i + _ROWS], d1[i : i + _ROWS] = at, d[rows, at]
        if d.shape[1] > 1:
            d[rows, at] = np.iinfo(np.int64).max if kind is np.int64 else np.inf
            d2[i : i + _ROWS] = d.min(axis=1)
    return best, d1, d2


class _Heaps:
    """The heaps of a block: for each part position and entry, pairs of (slack at no drift, row), smallest slack first."""

    def __init__(self, shape: tuple[int, int]):
        self.heaps: list[list] = [[] for _ in range(shape[0] * shape[1])]
        self.raw: list[tuple[bytes, bytes] | None] = [None] * len(self.heaps)  # those that were not opened since they were read
        self.entries = shape[1]

    @staticmethod
    def read(shape: tuple[int, int], sizes: bytes, keys: bytes, rows: bytes) -> _Heaps:
        out, at = _Heaps(shape), 0
        for i, n in enumerate(np.frombuffer(sizes, dtype="<i4").tolist()):
            out.raw[i] = (keys[8 * at : 8 * (at + n)], rows[4 * at : 4 * (at + n)])
            at += n
        return out

    def write(self) -> tuple[bytes, bytes, bytes]:
        pieces = [r if r is not None else (np.array([k for k, _ in h], dtype="<f8").tobytes(), np.array([x for _, x in h], dtype="<i4").tobytes()) for r, h in zip(self.raw, self.heaps, strict=True)]
        return np.array([len(x) // 4 for _, x in pieces], dtype="<i4").tobytes(), b"".join(k for k, _ in pieces), b"".join(x for _, x in pieces)

    def _opened(self, i: int) -> list:
        if (raw := self.raw[i]) is not None:
            self.heaps[i] = list(zip(np.frombuffer(raw[0], dtype="<f8").tolist(), np.frombuffer(raw[1], dtype="<i4").tolist(), strict=True))
            self.raw[i] = None
        return self.heaps[i]

    def violated(self, part: int, entry: int, drift: float) -> list[int]:
        i = part * self.entries + entry
        raw, out = self.raw[i], []
        if raw is not None and (not raw[0] or np.frombuffer(raw[0], dtype="<f8", count=1)[0] > drift):
            return out
        heap = self._opened(i)
        while heap and heap[0][0] <= drift:
            out.append(heappop(heap)[1])
        return out

    def fill(self, part: int, entry: np.ndarray, keys: np.ndarray) -> None:
        """Makes the heaps of a position, for rows 0, 1 and so on."""
        order = np.argsort(entry, kind="stable")
        ends = np.cumsum(np.bincount(entry, minlength=self.entries)).tolist()
        for e, (a, b) in enumerate(zip([0, *ends], ends, strict=False)):
            heap = list(zip(keys[order[a:b]].tolist(), order[a:b].tolist(), strict=True))
            heapify(heap)
            self.heaps[part * self.entries + e], self.raw[part * self.entries + e] = heap, None

    def push(self, part: int, entry: int, key: float, row: int) -> None:
        heappush(self._opened(part * self.entries + entry), (key, row))

    def members(self, part: int) -> Iterator[tuple[int, np.ndarray]]:
        for e in range(self.entries):
            i = part * self.entries + e
            raw = self.raw[i]
            yield e, np.frombuffer(raw[1], dtype="<i4") if raw is not None else np.array([x for _, x in self.heaps[i]], dtype=np.int64)


def _slack(d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    lower, upper = np.sqrt(np.where(d2 < 0, np.inf, d2.astype(np.float64))), np.sqrt(d1.astype(np.float64))
    return lower * (1 - _CAUTION) - upper * (1 + _CAUTION)


class _Sums:
    """Changes of the entries' sums and counts in one task."""

    def __init__(self, shape: tuple[int, ...]):
        self.sums, self.counts = np.zeros(shape, dtype=np.int64), np.zeros(shape[:2], dtype=np.int64)

    def add(self, part: int, entry: np.ndarray, vectors: np.ndarray, sign: int) -> None:
        np.add.at(self.sums[part], entry, sign * vectors.astype(np.int64))
        np.add.at(self.counts[part], entry, sign)

    def bytes(self) -> bytes:
        return np.concatenate([self.counts[:, :, None], self.sums], axis=2).astype("<i8").tobytes()


_STATE = "data binary, sizes binary, keys binary, rows binary, sums binary"


def _state_schema(df: DataFrame) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema if f.name in ("id", "label")}
    return f"id array<{kinds['id']}>, label array<{kinds['label']}>, {_STATE}"


def _list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _batch(ids: pa.Array, labels: pa.Array, data: bytes | None, heaps: _Heaps | None, sums: bytes | None) -> pa.RecordBatch:
    cells = [data, *(heaps.write() if heaps else (None, None, None)), sums]
    return pa.RecordBatch.from_arrays([_list(ids), _list(labels), *[pa.array([c], pa.binary()) for c in cells]], names=["id", "label", "data", "sizes", "keys", "rows", "sums"])


def _packed(ready: DataFrame, books: np.ndarray, block: int) -> DataFrame:
    """The first round: rows packed in blocks, every part measured. A row for each block, and one with the sums of each task."""
    shared = ready.sparkSession.sparkContext.broadcast(books)
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        sums, kinds = _Sums(books.shape), None
        for whole in batches:
            kinds = whole.column(0).slice(0, 0), whole.column(1).slice(0, 0)
            for i in range(0, whole.num_rows, block):
                batch = whole.slice(i, block)
                lists = batch.column(2)
                sizes = np.diff(lists.offsets.to_numpy())
                vectors = np.zeros((batch.num_rows, parts * width), dtype="<i4")
                vectors[np.arange(parts * width) < sizes[:, None]] = lists.flatten().to_numpy()
                heaps = _Heaps(books.shape[:2])
                for p in range(parts):
                    piece = vectors[:, p * width : (p + 1) * width]
                    best, d1, d2 = _measure(piece, books[p])
                    heaps.fill(p, best, _slack(d1, d2))
                    sums.add(p, best, piece, 1)
                yield _batch(batch.column(0), batch.column(1), vectors.tobytes(), heaps, None)
        if kinds:
            yield _batch(*kinds, None, None, sums.bytes())

    return ready.select("id", "label", "v").mapInArrow(run, _state_schema(ready))


def _vectors(data: bytes, parts: int, width: int) -> np.ndarray:
    return np.frombuffer(data, dtype="<i4").reshape(-1, parts * width) if width else np.empty((0, 0), dtype="<i4")


def _settle(heaps: _Heaps, vectors: np.ndarray, books: np.ndarray, drift: np.ndarray, sums: _Sums | None) -> None:
    """Pops the parts whose bounds the drift has violated and measures them again."""
    parts, entries, width = books.shape
    for p in range(parts if width else 0):
        popped = [(row, e) for e in range(entries) for row in heaps.violated(p, e, float(drift[p, e]))]
        if not popped:
            continue
        rows, old = np.array(popped, dtype=np.int64).T
        piece = vectors[rows, p * width : (p + 1) * width]
        best, d1, d2 = _measure(piece, books[p])
        for e, key, row in zip(best.tolist(), (_slack(d1, d2) + drift[p, best]).tolist(), rows.tolist(), strict=True):
            heaps.push(p, e, key, row)
        if sums is not None and (moved := np.flatnonzero(best != old)).size:
            sums.add(p, best[moved], piece[moved], 1)
            sums.add(p, old[moved], piece[moved], -1)


def _moved(state: DataFrame, books: np.ndarray, drift: np.ndarray) -> DataFrame:
    """A further round over the blocks of the one before."""
    shared = state.sparkSession.sparkContext.broadcast((books, drift))
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, drift = shared.value
        sums, kinds = _Sums(books.shape), None
        for batch in batches:
            ids, labels, data, sizes, keys, rows = (batch.column(i) for i in range(6))
            kinds = ids.values.slice(0, 0), labels.values.slice(0, 0)
            for i in range(batch.num_rows):
                heaps = _Heaps.read(books.shape[:2], sizes[i].as_py(), keys[i].as_py(), rows[i].as_py())
                _settle(heaps, _vectors(packed := data[i].as_py(), parts, width), books, drift, sums)
                yield _batch(ids[i].values, labels[i].values, packed, heaps, None)
        if kinds:
            yield _batch(*kinds, None, None, sums.bytes())

    return state.where("data is not null").mapInArrow(run, state.schema)


def _changes(state: DataFrame, shape: tuple[int, ...]) -> Iterator[tuple[int, int, int, list[int]]]:
    """Part, entry, change of its count and of its sums, over all tasks; as many rows as there are entries at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((*shape[:2], shape[2] + 1), dtype=np.int64)
        for batch in batches:
            for cell in batch.column(0).to_pylist():
                total += np.frombuffer(cell, dtype="<i8").reshape(total.shape)
        p, e = np.nonzero(total.any(axis=2))
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(total[p, e].tolist(), pa.list_(pa.int64()))], names=["p", "e", "x"])

    cells = state.where("sums is not null").select("sums").mapInArrow(run, "p int, e int, x array<long>")
    added = cells.select("p", "e", F.posexplode("x").alias("i", "x")).groupBy("p", "e", "i").agg(F.sum("x").alias("x"))
    for r in added.groupBy("p", "e").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda t: t["x"]).alias("x")).toArrow().to_pylist():
        yield r["p"], r["e"], r["x"][0], r["x"][1:]


def _coded(state: DataFrame, books: np.ndarray, drift: np.ndarray) -> DataFrame:
    """The last assignment. id, label, code and error of each row."""
    shared = state.sparkSession.sparkContext.broadcast((books, drift))
    parts, _, width = books.shape
    kinds = {f.name: f.dataType.elementType.simpleString() for f in state.schema if f.name in ("id", "label")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, drift = shared.value
        for batch in batches:
            ids, labels, data, sizes, keys, rows = (batch.column(i) for i in range(6))
            for i in range(batch.num_rows):
                heaps = _Heaps.read(books.shape[:2], sizes[i].as_py(), keys[i].as_py(), rows[i].as_py())
                vectors = _vectors(data[i].as_py(), parts, width)
                _settle(heaps, vectors, books, drift, None)
                n = len(ids[i].values)
                code, error = np.zeros((n, parts), dtype=np.uint8), np.zeros(n, dtype=np.uint64)
                for p in range(parts):
                    for e, members in heaps.members(p):
                        code[members, p] = e
                    if width:
                        away = vectors[:, p * width : (p + 1) * width].astype(np.int64) - books[p][code[:, p]]
                        error += (away * away).sum(axis=1).astype(np.uint64)
                digits = code.tobytes().hex()
                error = np.minimum(error, np.uint64((1 << 63) - 1)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([ids[i].values, labels[i].values, pa.array([digits[j : j + 2 * parts] for j in range(0, len(digits), 2 * parts)], pa.string()), pa.array(error)], names=["id", "label", "code", "error"])

    return state.where("data is not null").mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code string, error long")
