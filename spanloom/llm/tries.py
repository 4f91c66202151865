"""Prefix tries over conversations: every distinct beginning of turns as a node, with what its subtree holds.

Conversations that are equal turn by turn become one path. Paths are dealt out by a hash of their first turn, and a task builds
pointer tries of dictionaries over its share, which are summed up in postorder without recursion.

A first turn whose paths are more than one task should hold is cut: its paths go on together as far as they all agree (that run of
nodes has one child each), and from there they are dealt out by their next turn. This is repeated until every share is small. The
nodes above the cuts are summed up from the tops of the tries below, the deepest cuts first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import Scratch

#: Turns of the paths that share a beginning, beyond which it is cut; turns of a share on average.
LIMIT, SHARE = 1 << 16, 1 << 14
#: Original turns that a conversation may take over are fewer than this; conversations are rebuilt in families of so many ids.
TAKEN, FAMILY = 9, 5
#: Tables of up to so many cuts are sent to every task; larger ones are joined by shuffling.
FEW_CUTS = 20_000
#: Bytes of ids that are hashed at a time.
_CHUNK = 1 << 20
_NOBODY = hashlib.sha256(b"").hexdigest()


def rebuild(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, d (a 128-bit digest of role and text for each turn of the rebuilt conversation) and b (bytes of each text).

    A conversation's turns are ordered by turn, null first, equal ones by digest; repeated rows are turns of their own. Null role
    or text is empty. The first h turns of conversation c - c % FAMILY (of which there may be fewer or none), then c's own after
    its first h; h is crc32(c in decimal) % TAKEN. Rows without an id belong to no conversation. A conversation's digests and sizes
    (24 bytes a turn) are held by one task, its texts are not.
    """
    c, said, who = F.col(conv).cast("long"), F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, said)))
    flat = turns.where(F.col(conv).isNotNull()).select(c.alias("conv"), F.struct(F.col(turn).alias("turn"), digest.alias("d"), F.octet_length(said).cast("long").alias("b")).alias("t"))
    own = flat.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("t"))
    own = own.select("conv", F.transform("t", lambda t: F.struct(t["d"].alias("d"), t["b"].alias("b"))).alias("t"), (F.col("conv") - F.col("conv") % FAMILY).alias("base"))
    base = own.where(F.col("conv") == F.col("base")).select(F.col("conv").alias("base"), F.slice("t", 1, TAKEN - 1).alias("first"))
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % TAKEN).cast("int")
    first = F.coalesce(F.slice("first", F.lit(1), h), F.slice("t", 1, 0))
    path = F.concat(first, F.slice("t", h + 1, F.size("t")))
    return own.join(base, "base", "left").select("conv", path.alias("t")).select("conv", F.col("t.d").alias("d"), F.col("t.b").alias("b"))


def prefix_trie(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", limit: int = LIMIT, share: int = SHARE) -> DataFrame:
    """One row for each distinct beginning of rebuilt conversations: conv_id (its smallest member), depth (turns), parent_conv_id
    (null at the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Conversations are ordered and rebuilt as `rebuild` says; all that were rebuilt, without turns too, are members of the root. An
    empty table (or one without ids) has no root and gives no rows. Other columns may have any names.
    """
    tables = Scratch(turns.sparkSession, "tries")
    whole = tables.table(rebuild(turns, conv, turn, role, text).withColumn("key", F.unhex(F.md5(F.array_join(F.transform("d", F.hex), "")))), "whole")
    ends = _end_digests(whole.select("key", "conv"))
    same = whole.groupBy("key").agg(F.min("conv").alias("conv"), F.count("*").alias("n"), F.first("d").alias("d"), F.first("b").alias("b"))
    paths = tables.table(same.join(ends, "key").drop("key").withColumn("len", F.size("d")), "paths")
    cuts, shares, weight = _cut(paths.where("len > 0"), tables, limit)
    nodes = tables.table(_tries(shares, max(1, -(-weight // share))), "nodes")
    tops = nodes.where("top").select("owner", "conv", "n_convs", "n_leaves", "saved")
    upper = None
    for r, cut in reversed(list(enumerate(cuts))):
        found = tables.table(_joints(cut, tops), f"joints{r}")
        upper = found if upper is None else upper.unionByName(found)
        tops = tops.unionByName(found.where("top").select("owner", "conv", "n_convs", "n_leaves", "saved"))
    root = tables.table(_root(tops, paths.where("len = 0")), "root")
    above = root.select(F.lit(None).cast("binary").alias("id"), F.col("conv").alias("parent"))
    if upper is not None:
        above = above.unionByName(upper.where("id is not null").select("id", F.col("conv").alias("parent")))
        nodes = nodes.unionByName(upper.drop("id"))
    below = nodes.where("top").drop("parent").join(_small(tables.table(above, "above")), F.col("owner").eqNullSafe(F.col("id")))
    out = nodes.where("not top").drop("owner", "top").unionByName(below.drop("owner", "top", "id")).unionByName(root)
    return out.select(F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= FEW_CUTS else df


def _prefix(d: Column, n: Column) -> Column:
    return F.unhex(F.md5(F.array_join(F.transform(F.slice(d, F.lit(1), n), F.hex), "")))


# --- digests of the ids that end at a node ----------------------------------------------------------------------------


def _end_digests(members: DataFrame) -> DataFrame:
    """members: key, conv. For each key the SHA-256 of its ids in order.

    Rows are sorted by key and id over all tasks, so a key of very many ids lies in several. What a task holds whole, it digests;
    of its first and last key it sends on the ids as text, a chunk at a time, which are put together in a stream."""
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = members.repartitionByRange(parts, "key", "conv").sortWithinPartitions("key", "conv")
    order = order.select("key", "conv", F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, size, seq, part, first = None, [], 0, 0, 0, True
        found: list[tuple] = []

        def piece(whole: bool) -> None:
            text = ",".join(ids).encode()
            found.append((key, part, seq, *([hashlib.sha256(text).hexdigest(), None] if whole else [None, text])))

        def rows() -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) or [()] * 5
            kinds = (pa.binary(), pa.int32(), pa.int64(), pa.string(), pa.binary())
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["key", "part", "seq", "ends", "text"])

        for batch in batches:
            for k, c, part in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if k != key:
                    if ids:
                        piece(not first and not seq)  # it began in this task, and ended
                    first = key is None
                    key, ids, size, seq = k, [], 0, 0
                ids.append(str(c))
                size += len(ids[-1]) + 1
                if size > _CHUNK:
                    piece(False)
                    ids, size, seq = [], 0, seq + 1
                    yield rows()
            yield rows()
        if ids:
            piece(False)
            yield rows()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(found: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.binary()), pa.array([x if isinstance(x, str) else x.hexdigest() for _, x in found], pa.string())], names=["key", "ends"])

        last: list = []
        for batch in batches:
            found = last
            for k, digest, text in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if not found or k != found[-1][0]:
                    found.append((k, digest or hashlib.sha256(text)))
                else:
                    found[-1][1].update(b"," + text)
            found, last = found[:-1], found[-1:]
            yield rows(found)
        yield rows(last)

    pieces = order.mapInArrow(run, "key binary, part int, seq long, ends string, text binary")
    return pieces.repartition("key").sortWithinPartitions("key", "part", "seq").select("key", "ends", "text").mapInArrow(join, "key binary, ends string")


# --- cuts -------------------------------------------------------------------------------------------------------------


def _cut(paths: DataFrame, tables: Scratch, limit: int) -> tuple[list[DataFrame], DataFrame, int]:
    """The cuts by round, the paths with the group in which each is put into a trie, and how many turns these have in all.

    Of a group (id g) the first `cut` turns are the same in all paths; `owner` is the cut above it, null for the root. A cut has
    the group's id, cut, owner, upto (turns that all of its paths share), sizes of the turns from `cut` to `upto`, and the path that
    ends there, if one does."""
    live = paths.withColumns({"cut": F.lit(1), "g": _prefix(F.col("d"), F.lit(1)), "owner": F.lit(None).cast("binary")})
    settled, cuts, weight = [], [], 0
    while True:
        r = len(cuts)
        sizes = tables.table(live.groupBy("g").agg(F.sum(F.col("len") - F.col("cut") + 1).alias("w"), F.count("*").alias("k")), f"sizes{r}")
        heavy = (F.col("w") > limit) & (F.col("k") > 1)
        weight += sizes.agg(F.sum(F.when(~heavy, F.col("w")))).first()[0] or 0
        over = sizes.where(heavy).select("g")
        if not (n := over.count()):
            settled.append(live)
            break
        over = F.broadcast(over) if n <= FEW_CUTS else over
        marked = tables.table(live.join(over.withColumn("over", F.lit(True)), "g", "left"), f"live{r}")
        settled.append(marked.where("over is null").drop("over"))
        hot = marked.where("over").drop("over")
        bounds = hot.groupBy("g", "cut", "owner").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.max_by("b", "d").alias("b"))
        shared = (F.array_position(F.zip_with("lo", "hi", lambda a, b: a.eqNullSafe(b)), False) - 1).cast("int")
        bounds = bounds.withColumn("upto", shared).select("g", "cut", "owner", "upto", F.slice("b", F.col("cut"), F.col("upto") - F.col("cut") + 1).alias("sizes"))
        bounds = tables.table(bounds, f"bounds{r}")
        upto = bounds.select("g", "upto")
        going = tables.table(hot.drop("owner", "cut").join(F.broadcast(upto) if n <= FEW_CUTS else upto, "g"), f"going{r}")
        ended = going.where("len = upto").select(F.col("g").alias("eg"), F.col("conv").alias("end_conv"), F.col("n").alias("end_n"), F.col("ends").alias("end_ends"))
        cuts.append(tables.table(bounds.join(ended, F.col("g") == F.col("eg"), "left").drop("eg").withColumnRenamed("g", "id"), f"cut{r}"))
        live = going.where("len > upto").withColumnRenamed("g", "owner").withColumn("cut", F.col("upto") + 1).withColumn("g", _prefix(F.col("d"), F.col("cut"))).drop("upto")
    shares = settled[0]
    for more in settled[1:]:
        shares = shares.unionByName(more)
    return cuts, shares, weight


def _joints(cut: DataFrame, tops: DataFrame) -> DataFrame:
    """The node where each cut branches and the run of nodes above it, with the id of the cut at the former."""
    below = tops.where("owner is not null").groupBy("owner").agg(F.min("conv").alias("c"), F.sum("n_convs").alias("n"), F.count("*").alias("k"), F.sum("n_leaves").alias("l"), F.sum("saved").alias("s"))
    both = cut.join(below.withColumnRenamed("owner", "of"), F.col("id") == F.col("of"))
    both = both.withColumn("conv", F.least("c", "end_conv")).withColumn("n_convs", F.col("n") + F.coalesce("end_n", F.lit(0)))
    both = both.withColumn("depth", F.explode(F.sequence("cut", "upto")))
    last, top = F.col("depth") == F.col("upto"), F.col("depth") == F.col("cut")
    down = F.aggregate(F.slice("sizes", F.col("depth") - F.col("cut") + 1, F.size("sizes")), F.lit(0).cast("long"), lambda a, x: a + x)
    return both.select(
        F.when(last, F.col("id")).alias("id"), F.when(top, F.col("owner")).alias("owner"), top.alias("top"), "conv", F.col("depth").cast("long").alias("depth"), F.when(~top, F.col("conv")).alias("parent"), "n_convs",
        F.when(last, F.col("k")).otherwise(1).alias("n_children"), F.col("l").alias("n_leaves"), (F.col("s") + (F.col("n_convs") - 1) * down).alias("saved"), F.when(last & F.col("end_ends").isNotNull(), F.col("end_ends")).otherwise(_NOBODY).alias("ends"),
    )


def _root(tops: DataFrame, none: DataFrame) -> DataFrame:
    """The node of no turns, if there is any conversation. none: the path without turns, if there is one."""
    zero = F.lit(0).cast("long")
    below = tops.where("owner is null").select("conv", F.col("n_convs").alias("n"), F.lit(1).alias("k"), F.col("n_leaves").alias("l"), F.col("saved").alias("s"), F.lit(None).cast("string").alias("e"))
    ended = none.select("conv", "n", F.lit(0).alias("k"), zero.alias("l"), zero.alias("s"), F.col("ends").alias("e"))
    both = below.unionByName(ended).agg(F.min("conv").alias("conv"), F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum("l").alias("l"), F.sum("s").alias("s"), F.max("e").alias("e"))
    return both.where("conv is not null").select(
        "conv", zero.alias("depth"), F.lit(None).cast("long").alias("parent"), F.col("n").alias("n_convs"), F.col("k").alias("n_children"), F.greatest("l", F.lit(1)).alias("n_leaves"), F.col("s").alias("saved"), F.coalesce("e", F.lit(_NOBODY)).alias("ends"),
    )


# --- tries ------------------------------------------------------------------------------------------------------------


def _tries(shares: DataFrame, buckets: int) -> DataFrame:
    """The nodes of each group's trie from its top on: owner (of tops), top, conv, depth, parent (null for tops) and the sums."""
    dealt = shares.withColumn("bucket", F.pmod(F.xxhash64("g"), F.lit(buckets))).select("bucket", "g", "owner", "cut", "d", "b", "conv", "n", "ends")
    return dealt.groupBy("bucket").applyInPandas(_build, "owner binary, top boolean, conv long, depth long, parent long, n_convs long, n_children long, n_leaves long, saved long, ends string")


def _build(paths: pd.DataFrame) -> pd.DataFrame:
    tops: dict[bytes, int] = {}
    children: list[dict[bytes, int]] = []
    depth, size, conv, n, owner, ends = [], [], [], [], [], []

    def node(at: int, bytes_: int, of: bytes | None = None) -> int:
        children.append({})
        for column, value in ((depth, at), (size, bytes_), (conv, None), (n, 0), (owner, of), (ends, _NOBODY)):
            column.append(value)
        return len(depth) - 1

    for row in paths.itertuples(index=False):
        d, b, cut = row.d, row.b, int(row.cut)
        here = tops.get(row.g)
        if here is None:
            here = tops[row.g] = node(cut, int(b[cut - 1]), row.owner)
        for i in range(cut, len(d)):
            below = children[here].get(d[i])
            if below is None:
                below = children[here][d[i]] = node(i + 1, int(b[i]))
            here = below
        conv[here], n[here], ends[here] = int(row.conv), int(row.n), row.ends
    parent: list[int | None] = [None] * len(depth)
    leaves, saved = [0] * len(depth), [0] * len(depth)
    for top in tops.values():
        stack = [(top, iter(children[top].values()))]
        while stack:
            here, rest = stack[-1]
            if (below := next(rest, None)) is not None:
                parent[below] = here
                stack.append((below, iter(children[below].values())))
                continue
            stack.pop()
            for below in children[here].values():
                conv[here] = conv[below] if conv[here] is None else min(conv[here], conv[below])
                n[here] += n[below]
                leaves[here] += leaves[below]
                saved[here] += saved[below]
            leaves[here] = leaves[here] or 1
            saved[here] += (n[here] - 1) * size[here]
    up = [None if p is None else conv[p] for p in parent]
    return pd.DataFrame({
        "owner": owner, "top": [p is None for p in parent], "conv": conv, "depth": depth, "parent": pd.array(up, dtype="Int64"), "n_convs": n, "n_children": [len(c) for c in children], "n_leaves": leaves, "saved": saved, "ends": ends,
    })
