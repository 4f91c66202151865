"""Folding many small groups without a call into Python for each."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

#: Result rows that a task holds before it sends them on.
_HELD = 10_000


def fold_groups(df: DataFrame, group: list[str], order: list[str], fold: Callable[[list[dict]], list[tuple]], schema: str) -> DataFrame:
    """Calls fold() with the rows of each group, in order, and returns its rows.

    Groups are dealt by their key and sorted within partitions, so a task streams through whole groups and holds one at a
    time. A group must fit in memory: the caller cuts groups where they cannot interact."""
    names = df.columns
    out_schema = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        out: list[tuple] = []
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(out_schema)], names=out_schema.names)
        for batch in batches:
            for values in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                row = dict(zip(names, values, strict=True))
                if held and any(row[g] != held[0][g] for g in group):
                    out += fold(held)
                    held = []
                held.append(row)
            if len(out) >= _HELD:
                yield batch_of(out)
                out = []
        if held:
            out += fold(held)
        yield batch_of(out)

    return df.repartition(*group).sortWithinPartitions(*group, *order).mapInArrow(run, schema)


def fold_columns(df: DataFrame, group: list[str], order: list[str], fold: Callable[[pa.Table], dict], schema: str) -> DataFrame:
    """As fold_groups, for groups with many rows: fold() gets a group's columns and returns columns of its results by name; the
    group's own columns are added to them as they are."""
    out_schema = to_arrow_schema(_parse_datatype_string(schema))
    types = {f.name: f.type for f in out_schema}

    def result(part: pa.Table) -> pa.RecordBatch:
        found = fold(part)
        n = len(next(iter(found.values())))
        heads = {g: pa.repeat(part.column(g)[0].cast(types[g]), n) if part.column(g)[0].is_valid else pa.nulls(n, types[g]) for g in group if g in types}
        return pa.RecordBatch.from_arrays([heads[f] if f in heads else pa.array(found[f], types[f]) for f in out_schema.names], names=out_schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            keys = [batch.column(batch.schema.get_field_index(g)) for g in group]
            new = np.zeros(batch.num_rows, dtype=bool)
            for k in keys:
                a, b = k.slice(1), k.slice(0, max(len(k) - 1, 0))
                same = pc.fill_null(pc.equal(a, b), False)
                new[1:] |= ~np.asarray(pc.or_(same, pc.and_(a.is_null(), b.is_null())))
            if batch.num_rows:
                new[0] = not held or any(held[0].column(held[0].schema.get_field_index(g))[0] != k[0] for g, k in zip(group, keys, strict=True))
            cuts = [*np.flatnonzero(new).tolist(), batch.num_rows]
            if cuts[0]:
                held.append(batch.slice(0, cuts[0]))
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held:
                    yield result(pa.Table.from_batches(held))
                held = [batch.slice(a, b - a)]
        if held:
            yield result(pa.Table.from_batches(held))

    return df.repartition(*group).sortWithinPartitions(*group, *order).mapInArrow(run, schema)
