"""Near-duplicate documents by an LSH forest over MinHash signatures, with links confirmed on full shingle sets.

Documents with equal shingle sets form a class; all further work is on classes. A class's signature is cut into the labels of
several trees. Each tree is a sorted order of the labels; neighbours in it are candidates as far as their longest common
prefix reaches. The depth of that prefix adapts to the region: it starts at `BASE` values, and where more classes share so
much than one task compares, the order is cut at longer common prefixes, so that the nearest neighbours meet first. Regions
that are the same in several trees are looked at once. Inside a region all pairs are compared exactly, and a spanning set of
the links leaves the task.

What a deeper cut may miss is made up for: after components are known, large regions that still hold several of them are
compared in pairs of blocks, of which only pairs across components matter. So every pair that shares a prefix of `BASE`
values in any tree is settled on full sets, whatever the sizes of regions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import KeyFilter, Scratch, slices, text_key

SHINGLE = 5
#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Trees, values in each label, values of the shortest prefix that makes candidates. A pair at the threshold of 0.85 shares
#: such a prefix in some tree with probability 1 - (1 - 0.85**4)**20 = 0.9999996.
TREES, DEPTH, BASE = 20, 6, 4
#: What of a region one task compares, in classes; a class with a large set counts as one for each SET_UNIT shingles begun.
REGION, SET_UNIT = 256, 4096
#: Regions' worth of classes in a block: each class of a large region goes to as many tasks as the region has blocks.
BLOCK = 4

_U = np.uint64
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_BASE = 0x2545F4914F6CDD1D
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_FACTORS = _mix(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64) * _U(0xD1342543DE82EF95)) | _U(1)
_POWERS: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers(size: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < size:
        for i, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps)
    return _POWERS


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles: hashes of the words' bytes, single spaces between them."""
    words = [[] if t is None else t.encode("utf-8", "replace").translate(_LOWER).split() for t in texts]
    data = np.frombuffer(b" ".join([b" ".join(w) for w in words if w]), dtype=np.uint8)
    if not len(data):
        return [np.empty(0, dtype=np.uint64) for _ in texts]
    power, inverse = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[data] * power[: len(data)], out=total[1:])
    spaces = np.flatnonzero(data == 32)
    starts, ends = np.concatenate([[0], spaces + 1]), np.concatenate([spaces, [len(data)]])
    out, at = [], 0
    counts = np.array([len(w) for w in words])
    offsets = np.cumsum(counts) - counts
    number = np.maximum(counts - SHINGLE + 1, np.minimum(counts, 1))
    first = np.repeat(offsets, number) + np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
    last = first + np.repeat(np.minimum(counts, SHINGLE), number) - 1
    a, b = starts[first], ends[last]
    hashes = _mix((total[b] - total[a]) * inverse[a] + (b - a).astype(np.uint64) * _U(0x9E3779B97F4A7C15))
    for n in number.tolist():
        out.append(np.unique(hashes[at : at + n]))
        at += n
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of TREES * DEPTH minima for each set; none may be empty."""
    out = np.empty((len(sets), len(_FACTORS)), dtype=np.uint32)
    i = 0
    while i < len(sets):  # so many hashes at a time that they stay in the cache
        j, size = i, 0
        while j < len(sets) and (j == i or size + len(sets[j]) <= 32_768):
            size += len(sets[j])
            j += 1
        data = np.concatenate(sets[i:j])
        starts = np.cumsum([0] + [len(s) for s in sets[i : j - 1]])
        for k, factor in enumerate(_FACTORS):
            out[i:j, k] = np.minimum.reduceat(((data * factor) >> _U(32)).astype(np.uint32), starts)
        i = j
    return out


def _prefixes(signature: np.ndarray, depth: int) -> np.ndarray:
    """For each row and tree a hash of the tree and the first values of its label."""
    labels = signature.reshape(len(signature), TREES, DEPTH)
    out = np.broadcast_to(_mix(np.arange(1, TREES + 1, dtype=np.uint64)), (len(signature), TREES)).copy()
    for d in range(depth):
        out = _mix(out * _U(0xD6E8FEB86659FD93) + labels[:, :, d].astype(np.uint64) + _U(d + 1))
    return out.view(np.int64)


def _documents(docs: DataFrame) -> DataFrame:
    """docs: t, id, tk. Adds key (a hash of the set, null if it is empty), n (its size) and sig; keeps id and tk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 0, 1 << 20):
                sets = shingle_sets(batch.column(0).to_pylist())
                full = [s for s in sets if len(s)]
                rows = iter(signatures(full)) if full else iter(())
                keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                sigs = [next(rows).tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(keys, pa.binary()), pa.array(map(len, sets), pa.int64()), pa.array(sigs, pa.binary())], names=["id", "tk", "key", "n", "sig"])

    return docs.select("t", "id", "tk").mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, tk long, key binary, n long, sig binary")


def _signature_rows(batch: pa.RecordBatch, column: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(column).to_pylist()), dtype=np.uint32).reshape(batch.num_rows, TREES * DEPTH)


def _regions(classes: DataFrame) -> DataFrame:
    """classes: sig. p: the shortest prefixes, one for each tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(_prefixes(_signature_rows(batch, 0), BASE).ravel())], names=["p"])

    return classes.select("sig").mapInArrow(run, "p long")


def _members(classes: DataFrame, shared_by_many: KeyFilter) -> DataFrame:
    """classes: key, sig, n. A row for each tree in which the class's shortest prefix passes the filter: label (the tree, then its
    values, in bytes that sort as they do), key and weight."""
    shared = classes.sparkSession.sparkContext.broadcast(shared_by_many)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = _signature_rows(batch, 1)
            p = _prefixes(sig, BASE)
            row, tree = np.nonzero(shared.value.has(p.ravel()).reshape(p.shape))
            labels = np.empty((len(row), DEPTH + 1), dtype=">u4")
            labels[:, 0], labels[:, 1:] = tree, sig.reshape(len(sig), TREES, DEPTH)[row, tree]
            label = pa.FixedSizeBinaryArray.from_buffers(pa.binary(_LABEL), len(row), [None, pa.py_buffer(labels.tobytes())]).cast(pa.binary())
            weight = -(-np.asarray(batch.column(2))[row] // SET_UNIT)
            yield pa.RecordBatch.from_arrays([label, batch.column(0).take(pa.array(row)), pa.array(weight)], names=["label", "key", "weight"])

    return classes.select("key", "sig", "n").mapInArrow(run, "label binary, key binary, weight long")


_LABEL = 4 * (DEPTH + 1)


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many values labels have in common from the first on, not counting the tree; -1 for labels of different trees."""
    return np.cumprod(a == b, axis=1).sum(axis=1) - 1


def _order(members: DataFrame) -> DataFrame:
    """The trees' sorted orders, cut by range into even parts: part, row, label, key, weight, before (the weight of the part's rows
    before this one) and common (values in common with the row before; null for a part's first row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows, total, last = TaskContext.get().partitionId(), 0, 0, None
        for batch in batches:
            if not (n := batch.num_rows):
                continue
            labels = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=">u4").reshape(n, DEPTH + 1)
            weight = np.asarray(batch.column(2))
            common = _common(labels, np.concatenate([labels[:1] if last is None else last, labels[:-1]]))
            mask = np.arange(n) == 0 if last is None else np.zeros(n, dtype=bool)
            before = total + np.cumsum(weight) - weight
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(part, pa.int32()), n), pa.array(rows + np.arange(n)), *batch.columns, pa.array(before), pa.array(common.astype(np.int32), mask=mask)], names=["part", "row", "label", "key", "weight", "before", "common"])
            rows, total, last = rows + n, total + int(weight.sum()), labels[-1:]

    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = members.repartitionByRange(parts, "label", "key").sortWithinPartitions("label", "key")
    return sorted_.mapInArrow(run, "part int, row long, label binary, key binary, weight long, before long, common int")


def _forest(members: DataFrame, tables: Scratch, region: int) -> DataFrame:
    """key, p and m (the region of the shortest prefix and its weight) and q, the region of the least depth at which one task can
    compare it; where even the last depth is too heavy, a share of that region by a hash. Classes without a neighbour are left out.

    A region is a run of the order in which neighbours have `depth` values in common, so it is known from where it begins and
    the next one does. Within a part these are a running maximum and minimum; beyond a part's bounds they come from one row
    for each part."""
    order = tables.table(_order(members), "order")
    depths = range(BASE, DEPTH + 1)
    begins = {d: F.when(F.col("common") < d, F.col("before")) for d in depths}
    bounds = order.groupBy("part").agg(
        F.sum("weight").alias("weight"), F.min_by("label", "row").alias("head"), F.max_by("label", "row").alias("tail"),
        *[F.min(b).alias(f"first{d}") for d, b in begins.items()], *[F.max(b).alias(f"last{d}") for d, b in begins.items()],
    )
    found = sorted((r.asDict() for r in bounds.collect()), key=lambda r: r["part"])
    base, tail = 0, None
    for r in found:
        r["base"], base = base, base + r["weight"]
        pair = [np.frombuffer(bytes(x), dtype=">u4").reshape(1, -1) for x in (tail, r["head"])] if tail is not None else None
        r["common"], tail = -1 if pair is None else int(_common(*pair)[0]), r["tail"]
    for d in depths:
        at = 0
        for r in found:
            r[f"entry{d}"] = at
            at = next((r["base"] + x for x in (r[f"last{d}"], 0 if r["common"] < d else None) if x is not None), at)
        at = base
        for r in reversed(found):
            r[f"exit{d}"] = at
            at = next((r["base"] + x for x in (0 if r["common"] < d else None, r[f"first{d}"]) if x is not None), at)
    names = ["base", "common", *[f"{x}{d}" for d in depths for x in ("entry", "exit")]]
    known = order.sparkSession.createDataFrame([(r["part"], *[r[n] for n in names]) for r in found], "part int, " + ", ".join(f"_{n} long" for n in names))
    to_here = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("part").orderBy(F.desc("row")).rowsBetween(Window.unboundedPreceding, -1)  # running, unlike a frame to the end
    rows = order.join(F.broadcast(known), "part").withColumns({"at": F.col("_base") + F.col("before"), "shared": F.coalesce("common", "_common")})  # a row for each part
    starts = {d: F.when(F.col("shared") < d, F.col("at")) for d in depths}
    rows = rows.withColumns({f"start{d}": F.coalesce(F.max(s).over(to_here), F.col(f"_entry{d}")) for d, s in starts.items()} | {f"end{d}": F.coalesce(F.min(s).over(after), F.col(f"_exit{d}")) for d, s in starts.items()})
    size = {d: F.col(f"end{d}") - F.col(f"start{d}") for d in depths}
    q = F.xxhash64(F.lit(DEPTH), f"start{DEPTH}", F.pmod(F.xxhash64("key"), F.ceil(size[DEPTH] / F.lit(region)).cast("long")))
    for d in reversed(depths):
        q = F.when(size[d] <= region, F.xxhash64(F.lit(d), f"start{d}")).otherwise(q)
    return tables.table(rows.where(size[BASE] > F.col("weight")).select("key", F.col(f"start{BASE}").alias("p"), size[BASE].alias("m"), q.alias("q")), "forest")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """docs: t, id. key and set for the classes in `wanted` (key, rep): a document of each is read again."""
    filter_ = KeyFilter.build(wanted.select(F.xxhash64("rep").alias("h")), "h", 21)
    shared = docs.sparkSession.sparkContext.broadcast(filter_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            taken = np.flatnonzero(shared.value.has(np.asarray(whole.column(1))))
            for batch in slices(whole.take(pa.array(taken)), 0, 1 << 20):
                sets = [s for s in shingle_sets(batch.column(0).to_pylist()) if len(s)]
                data = [s.tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(d) for d in data], pa.binary()), pa.array(data, pa.binary())], names=["key", "set"])

    found = docs.where(F.col("t").isNotNull()).select("t", F.xxhash64("id").alias("h")).mapInArrow(run, "key binary, set binary")
    return found.join(wanted.select("key"), "key", "left_semi").groupBy("key").agg(F.first("set").alias("set"))


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def links(sets: list[np.ndarray], union: _Union, across: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """A spanning set of the links between the sets, by exact comparison of all pairs not yet joined.

    union: joins that are known before. across: a number for each set; only pairs with different numbers are compared.
    """
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(int(ids.max()) + 1, dtype=np.int64)
    for i in range(len(sets) - 1):
        own = ids[starts[i] : starts[i] + sizes[i]]
        mark[own] = 1
        both = np.add.reduceat(mark[ids[starts[i + 1] :]], starts[i + 1 :] - starts[i + 1])
        mark[own] = 0
        near = 100 * both >= PERCENT * (sizes[i] + sizes[i + 1 :] - both)
        if across is not None:
            near &= across[i + 1 :] != across[i]
        for j in (np.flatnonzero(near) + i + 1).tolist():
            if union.join(i, j):
                yield i, j


def _in_groups(rows: DataFrame, group: list[str], compare: Callable[[list[dict]], list[tuple[bytes, bytes]]]) -> DataFrame:
    """rows: the group's columns and others. compare() gets a whole group; groups stay together and are held one at a time."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        out: list[tuple[bytes, bytes]] = []
        batch_of = lambda pairs: pa.RecordBatch.from_arrays([pa.array([x[i] for x in pairs], pa.binary()) for i in (0, 1)], names=["a", "b"])
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(len(names))]
            for values in zip(*columns, strict=True):
                row = dict(zip(names, values, strict=True))
                if held and any(row[g] != held[0][g] for g in group):
                    out += compare(held)
                    held = []
                held.append(row)
            if len(out) > 10_000:
                yield batch_of(out)
                out = []
        if held:
            out += compare(held)
        yield batch_of(out)

    return rows.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, "a binary, b binary")


def _compare_region(rows: list[dict]) -> list[tuple[bytes, bytes]]:
    if len(rows) < 2:
        return []
    rows = sorted(rows, key=lambda r: r["key"])
    pairs = links([np.frombuffer(r["set"], dtype=np.uint64) for r in rows], _Union(len(rows)))
    return [(rows[i]["key"], rows[j]["key"]) for i, j in pairs]


def _compare_blocks(rows: list[dict]) -> list[tuple[bytes, bytes]]:
    """Rows of two blocks of a region (or of one); comp: their components so far."""
    rows = sorted(rows, key=lambda r: (r["block"], r["key"]))
    numbers = {c: i for i, c in enumerate(sorted({r["comp"] for r in rows}))}
    comps = np.array([numbers[r["comp"]] for r in rows])
    union, first = _Union(len(rows)), {}
    for i, c in enumerate(comps.tolist()):
        union.join(first.setdefault(c, i), i)
    if len(numbers) < 2:
        return []
    pairs = links([np.frombuffer(r["set"], dtype=np.uint64) for r in rows], union, comps)
    return [(rows[i]["key"], rows[j]["key"]) for i, j in pairs]


def connected_components(edges: DataFrame, tables: Scratch) -> DataFrame:
    """node and comp, the least node of its component, for all nodes of the edges (a, b).

    Each round takes the least label among a node's neighbours and then that label's label, so the rounds needed grow with
    the logarithm of a component's diameter. Every round is written to the shared folder.
    """
    both = tables.table(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = tables.table(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")), "labels0")
    number = 0
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("m"))
        hooked = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "m").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
        number += 1
        new = tables.table(hooked.join(jump, "comp").select("node", "old", F.least("comp", "far").alias("comp")), f"labels{number}")
        moved = new.where(F.col("old") != F.col("comp")).limit(1).count()
        tables.drop(f"labels{number - 1}")
        labels = new.select("node", "comp")
        if not moved:
            return labels


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", region: int = REGION) -> DataFrame:
    """For each row id_col, text_key, n_shingles, component_id, kept and component.

    component names the component itself, component_id is its smallest id (nulls aside) and kept whether that is the row's
    own. A null text, or one without words, has no shingles, is its own component and kept. Rows that repeat are linked as
    any others; rows that share an id but not their text are told apart. text_key (with the id) finds a row's text again.
    An empty table gives no rows; other columns are not read.
    """
    tables = Scratch(docs.sparkSession, "neardup")
    rows = docs.select(F.col(text).alias("t"), F.col(id_col).alias("id"), text_key(text).alias("tk"))
    documents = tables.table(_documents(rows), "documents")
    classes = tables.table(documents.where("key is not null").groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig")), "classes")

    sizes = tables.table(_regions(classes).groupBy("p").agg(F.count("*").alias("m")).where("m > 1"), "sizes")
    forest = _forest(_members(classes, KeyFilter.build(sizes, "p")), tables, region)
    tables.drop("sizes", "order")
    sets = tables.table(_sets(rows, forest.select("key").distinct().join(classes.select("key", "rep"), "key")), "sets")

    small = forest.where(F.col("m") <= region)
    same = small.groupBy("q").agg(F.bit_xor(F.xxhash64("key")).alias("x"), F.sum(F.shiftright(F.xxhash64("key"), 24)).alias("s"), F.count("*").alias("m"))
    once = same.groupBy("x", "s", "m").agg(F.min("q").alias("q")).select("q")
    groups = small.select("q", "key").join(once, "q")
    large = forest.where(F.col("m") > region)
    any_large = large.limit(1).count() > 0
    if any_large:
        groups = groups.unionByName(large.select("q", "key"))
    edges = tables.table(_in_groups(groups.join(sets, "key").select("q", "key", "set"), ["q"], _compare_region).distinct(), "links")
    labels = connected_components(edges, tables)
    if any_large:
        more = _across_blocks(large, sets, labels, tables, region)
        if more.limit(1).count():
            labels = connected_components(edges.unionByName(more), tables)
    tables.drop("sets", "forest")

    reps = classes.select("key", "rep", "copies").join(labels.withColumnRenamed("node", "key"), "key", "left")
    least = reps.where("comp is not null").groupBy("comp").agg(F.min("rep").alias("least"))
    linked = tables.table(reps.where("comp is not null").join(tables.table(least, "least"), "comp").select("key", "comp", "least"), "linked")
    copied = classes.where("copies > 1").select("key", "rep").join(linked.select("key"), "key", "left_anti").select("key", F.col("key").alias("comp"), F.col("rep").alias("least"))
    found = tables.table(linked.unionByName(copied), "components")
    result = documents.select("id", "tk", "key", "n").join(found, "key", "left")
    least_id = F.when(F.col("comp").isNull(), F.col("id")).otherwise(F.col("least"))
    own = F.when(F.col("key").isNull(), F.concat_ws("-", F.lit(""), F.hex("id"), F.hex("tk"))).otherwise(F.hex(F.coalesce("comp", "key")))
    return result.select(F.col("id").alias(id_col), F.col("tk").alias("text_key"), F.col("n").alias("n_shingles"), least_id.alias("component_id"), F.col("id").eqNullSafe(least_id).alias("kept"), own.alias("component"))


def _across_blocks(large: DataFrame, sets: DataFrame, labels: DataFrame, tables: Scratch, region: int) -> DataFrame:
    """Links across components within large regions: their classes are dealt into blocks, and each pair of blocks is a task's."""
    known = large.select("p", "key", "m").join(labels.withColumnRenamed("node", "key"), "key", "left").select("p", "key", "m", F.coalesce("comp", "key").alias("comp"))
    known = tables.table(known, "known")
    mixed = known.groupBy("p").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where(F.col("lo") != F.col("hi")).select("p")
    blocks = F.ceil(F.col("m") / F.lit(region * BLOCK)).cast("int")
    rows = known.join(mixed, "p").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j")))
    dealt = rows.select("p", "key", "comp", "block", F.explode(pairs).alias("of")).select("p", "key", "comp", "block", "of.i", "of.j")
    return tables.table(_in_groups(dealt.join(sets, "key").select("p", "i", "j", "key", "comp", "block", "set"), ["p", "i", "j"], _compare_blocks).distinct(), "more")
