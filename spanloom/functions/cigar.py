"""CIGAR strings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OPS = r"(\d+)([MIDNSHP=X])"
ON_REFERENCE, ON_QUERY = "MDN=X", "MIS=X"


def ops(cigar: Column) -> Column:
    """array<struct<len:int, op:string>>; empty for null or `*`."""
    text = F.coalesce(cigar, F.lit(""))
    return F.zip_with(F.regexp_extract_all(text, F.lit(_OPS), F.lit(1)), F.regexp_extract_all(text, F.lit(_OPS), F.lit(2)), lambda n, op: F.struct(n.cast("int").alias("len"), op.alias("op")))


def total(cigar: Column, kinds: str) -> Column:
    """Sum of the lengths of the operations of these kinds."""
    sizes = F.regexp_extract_all(F.coalesce(cigar, F.lit("")), F.lit(rf"(\d+)[{kinds}]"), F.lit(1))
    return F.aggregate(sizes, F.lit(0), lambda n, size: n + size.cast("int"))


def reference_length(cigar: Column) -> Column:
    return total(cigar, ON_REFERENCE)


def query_length(cigar: Column) -> Column:
    return total(cigar, ON_QUERY)


def _clip(cigar: Column, pattern: str) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(F.coalesce(cigar, F.lit("")), pattern, 1), F.lit("")).cast("int"), F.lit(0))


def left_clip(cigar: Column) -> Column:
    return _clip(cigar, r"^(\d+)S")


def right_clip(cigar: Column) -> Column:
    return _clip(cigar, r"(\d+)S$")


def end_position(pos: Column, cigar: Column) -> Column:
    """One past the last base on the reference."""
    return pos + reference_length(cigar)


def mate_end(mate_pos: Column, mate_cigar: Column) -> Column:
    """Last base of the mate on the reference, inclusive; the mate's position where its CIGAR is missing. All operations but
    insertions and soft clips count."""
    return F.when(mate_cigar.isNull() | (mate_cigar == "*") | (mate_cigar == ""), mate_pos).otherwise(mate_pos + total(mate_cigar, "MDNHP=X") - 1)


def unclipped_start(pos: Column, cigar: Column) -> Column:
    return pos - left_clip(cigar)


def unclipped_end(pos: Column, cigar: Column) -> Column:
    return end_position(pos, cigar) + right_clip(cigar)


def indels_in_first(cigar: Column, n: Column | int) -> Column:
    """struct<dels:int, ins:int> within the first n bases along the reference; soft clips count as bases of it."""
    n = F.lit(n) if isinstance(n, int) else n
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("dels"), F.lit(0).alias("ins"))

    def step(s: Column, o: Column) -> Column:
        live = s["at"] < n
        deletion, insertion = o["op"] == "D", o["op"] == "I"
        moves = o["op"].isin(*"MDN=XS")
        used = F.least(o["len"], n - s["at"])
        return F.struct(
            (s["at"] + F.when(live & moves, o["len"]).otherwise(0)).alias("at"),
            (s["dels"] + F.when(live & deletion, used).otherwise(0)).alias("dels"),
            (s["ins"] + F.when(live & insertion, o["len"]).otherwise(0)).alias("ins"),
        )

    return F.aggregate(ops(cigar), zero, step, lambda s: F.struct(s["dels"], s["ins"]))


def to_text(parsed: Column) -> Column:
    return F.array_join(F.transform(parsed, lambda o: F.concat(o["len"].cast("string"), o["op"])), "")
