"""Windows of reference sequences that are kept in chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_reference(df: DataFrame, reference: DataFrame, key: list[str], contig: str, low: str, high: str, name: str, chunk: int) -> DataFrame:
    """Adds the reference between low and high (half-open, cut at the contig's ends) of each row.

    `key` tells rows apart. Only the chunks that a window touches are joined, by contig and chunk number."""
    first, last = F.expr(f"greatest({low}, 0) div {chunk}"), F.expr(f"(greatest({high}, 1) - 1) div {chunk}")
    wanted = df.select(*key, F.col(contig).alias("__c"), F.greatest(low, F.lit(0)).alias("__lo"), F.col(high).alias("__hi"), F.explode(F.sequence(first, F.greatest(first, last))).alias("__n"))
    joined = wanted.join(reference.select(F.col("contig").alias("__c"), F.col("chunk_id").alias("__n"), "chunk"), ["__c", "__n"])
    begin = F.greatest(F.col("__lo") - F.col("__n") * chunk, F.lit(0))
    size = F.greatest(F.least(F.col("__hi") - F.col("__n") * chunk, F.lit(chunk)) - begin, F.lit(0))
    piece = F.col("chunk").substr((begin + 1).cast("int"), size.cast("int"))
    parts = joined.select(*key, F.struct("__n", piece.alias("s")).alias("__p")).groupBy(*key)
    found = parts.agg(F.array_join(F.transform(F.array_sort(F.collect_list("__p")), lambda p: p["s"]), "").alias(name))
    return df.join(found, key)
