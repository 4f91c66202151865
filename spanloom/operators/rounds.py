"""Greedy choices along a key without a task that holds the key: bins decide what cannot depend on other bins, round after round."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators.grouped import fold_groups
from spanloom.shared import Scratch

#: A bin's width in reaches; of it two lie so near an end that other bins may have a say. From 6 on any two places within a reach
#: are both away from the ends in one of two rounds, so rounds come to an end.
WIDTH = 32

#: (rows, first place, place after the last one) -> rows and whether each is settled.
Fold = Callable[[list[dict], int, int], list[tuple]]


def in_rounds(rows: DataFrame, keys: list[str], place: str, reach: int, order: list[str], fold: Fold, name: str) -> DataFrame:
    """Rows as fold() settles them, bin by bin of `place` (longs; rows without one are left out). What it does not settle goes into
    the next round, where bins are shifted by half their width.

    A choice may depend only on rows within `reach` of its place. The best of all choices that are left has none before it, and in
    one of two rounds its bin holds all that it depends on, so it is settled then and rounds come to an end; most rows are settled
    in the first. A round is a table in the shared folder. A bin must fit in a task's memory, a key need not."""
    spark, tables, width = rows.sparkSession, Scratch(rows.sparkSession, name, light=True), max(WIDTH * reach, 64)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", settled boolean"
    paths: list[str] = []
    while True:
        shift = width // 2 * (len(paths) % 2)
        at = F.col(place) + shift
        cut = rows.where(F.col(place).isNotNull()).withColumn("__bin", ((at - F.pmod(at, F.lit(width))) / width).cast("long"))

        def of_bin(group: list[dict], shift: int = shift) -> list[tuple]:
            low = group[0]["__bin"] * width - shift
            return fold(group, low, low + width)

        done = tables.table(fold_groups(cut, [*keys, "__bin"], order, of_bin, schema), f"round{len(paths)}")
        paths.append(tables.path(f"round{len(paths)}"))
        rows = done.where("not settled").drop("settled")
        if rows.isEmpty():
            return spark.read.schema(done.schema).parquet(*paths).where("settled").drop("settled")
