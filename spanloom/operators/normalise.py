"""Left-normalisation of insertions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from spanloom.operators.reference import with_reference

#: Bases left of an insertion that a first round looks at.
REACH = 2048


def normalise(start: int, end: int, seq: str, ref: str, ref_start: int) -> tuple[int, int, str, bool]:
    """(start, end, seq, whether the reference given was enough). start is the last base before what is replaced, end the last
    base replaced; the common ends of the sequence and what it replaces are trimmed, then a pure insertion rolls left."""
    replaced = ref[start + 1 - ref_start : end + 1 - ref_start]
    n = 0
    while n < min(len(seq), len(replaced)) and seq[n].upper() == replaced[n].upper():
        n += 1
    seq, replaced, start = seq[n:], replaced[n:], start + n
    n = 0
    while n < min(len(seq), len(replaced)) and seq[-1 - n].upper() == replaced[-1 - n].upper():
        n += 1
    if n:
        seq, end = seq[:-n], end - n
    if start == end and seq:
        turns = 0  # seq is rolled by `turns`, which is only spelt out at the end
        while start >= ref_start and ref[start - ref_start].upper() == seq[-1 - turns % len(seq)].upper():
            start, turns = start - 1, turns + 1
        turns %= len(seq)
        seq, end = seq[len(seq) - turns :] + seq[: len(seq) - turns], start
        if start < ref_start and ref_start > 0:
            return start, end, seq, False
    return start, end, seq, True


def left_normalise(calls: DataFrame, reference: DataFrame, chunk: int, reach: int = REACH) -> DataFrame:
    """calls: id (unique), contig, start, end, seq and others, which stay. Calls that roll beyond what a round looks at go
    through further rounds with twice the reach; calls before the first base and incomplete sequences (`-`) are dropped."""
    from pyspark.sql import functions as F

    names = calls.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            found = [normalise(r["start"], r["end"], r["seq"], r["__ref"], r["__low"]) for r in rows]
            new = {"start": pa.array([f[0] for f in found], pa.int64()), "end": pa.array([f[1] for f in found], pa.int64()), "seq": pa.array([f[2] for f in found], pa.string())}
            yield pa.RecordBatch.from_arrays([*[new.get(n, batch.column(n)) for n in names], pa.array([f[3] for f in found])], names=[*names, "__done"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in calls.schema)
    rest = calls.where(~F.col("seq").contains("-"))
    done = None
    while True:
        bounds = rest.withColumns({"__low": F.greatest(F.col("start") - reach, F.lit(0)), "__high": F.greatest("start", "end") + 1})
        placed = with_reference(bounds, reference, ["id"], "contig", "__low", "__high", "__ref", chunk)
        turned = placed.select(*names, "__low", "__ref").mapInArrow(run, f"{schema}, __done boolean")
        part = turned.where("__done").drop("__done")
        done = part if done is None else done.unionByName(part)
        rest, reach = turned.where("not __done").drop("__done"), reach * 2
        if not rest.limit(1).count():
            return done.where("start >= 0")
