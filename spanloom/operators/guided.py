"""Consensus of reads along a sequence that they should look like: contigs in order of alignment, joined by the reads that do not align.

Everything is a table over groups (one sequence and its reads each). Python sees one sequence with its few texts, a pair of texts, or
the vertices of one group, which has fewer than assembly.MOST_READS reads."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import alignments as A
from spanloom.functions import cigar as C
from spanloom.functions.align import PADDING, TO_BASE, Scoring, align, suffix_prefix_columns
from spanloom.operators.assembly import assemble_groups, heaviest_paths, spell
from spanloom.operators.clustering import greedy_pairs
from spanloom.operators.grouped import fold_groups
from spanloom.operators.remap import retain_disjoint, sweep_overlaps
from spanloom.shared import Scratch

#: Fixed value: letters on each side of a breakpoint that a contig must hold for it to be precise.
FLANK = 50


def lay(texts: DataFrame, wanted: DataFrame, group: str, text: str, name: str, query: str, scoring: Scoring = TO_BASE) -> DataFrame:
    """group, name, query_begin, query_end, begin, end (on the group's text, inclusive), mismatches, cigar: the best alignment of each
    query to its group's text; queries without one are left out. A text goes once to all queries of its group."""
    kinds = {f.name: f.dataType.simpleString() for f in wanted.schema}
    lists = wanted.where(F.length(query) > 0).groupBy(group).agg(F.collect_list(F.struct(F.col(name).alias("name"), F.col(query).alias("query"))).alias("__queries"))
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # an exchange of its own, as work is large for its bytes: the join's would be left to few tasks
    work = texts.select(group, F.col(text).alias("__text")).join(lists, group).repartition(parts, F.xxhash64(group))
    columns = [group, name, "query_begin", "query_end", "begin", "end", "mismatches", "cigar"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for g, ref, queries in zip(frame[group], frame["__text"], frame["__queries"], strict=True):
                found = [(q["name"], align(q["query"], ref, scoring)) for q in queries]
                yield pd.DataFrame([(g, n, a.query_begin, a.query_end, a.ref_begin, a.ref_end, a.mismatches, a.cigar) for n, a in found if a is not None], columns=columns)

    return work.mapInPandas(run, f"`{group}` {kinds[group]}, `{name}` {kinds[name]}, query_begin int, query_end int, begin int, end int, mismatches int, cigar string")


def _unclipped() -> Column:
    return (C.left_clip(F.col("cigar")) <= PADDING) & (C.right_clip(F.col("cigar")) <= PADDING)


def _aligned(reads: DataFrame, texts: DataFrame, group: str) -> DataFrame:
    """Adds begin and end on the text and accepted (null without an alignment) to reads, whose ends are padded so that they count."""
    pad = F.lit("N" * PADDING)
    found = lay(texts, reads.select(group, "read", F.concat(pad, "seq", pad).alias("q")), group, "text", "read", "q")
    cigar = F.col("cigar")
    ok = A.accepts(cigar, F.col("query_begin"), F.col("query_end"), F.col("mismatches"))
    found = found.select(group, "read", (F.col("begin") + PADDING - C.left_clip(cigar)).alias("begin"), (F.col("end") - PADDING + C.right_clip(cigar)).alias("end"), ok.alias("accepted"))
    return reads.join(found, [group, "read"], "left")


def _paths(aligned: DataFrame, group: str, least: int, error: float, longest: int) -> DataFrame:
    """group, n, seq: the heaviest paths over overlaps of reads in order of alignment, which cannot have a cycle, the best first, each
    column by majority of its reads; then reads on no path, in that order."""
    kind = aligned.schema[group].dataType.simpleString()
    seqs = lambda name: aligned.select(group, F.col("read").alias(name), F.col("seq").alias(f"{name}_seq"))
    near = sweep_overlaps(aligned, [group], "read", "begin", "end", least, longest).drop("overlap").join(seqs("a"), [group, "a"]).join(seqs("b"), [group, "b"])
    edges = near.select(group, "a", "b", suffix_prefix_columns(F.col("a_seq"), F.col("b_seq"), error, least).alias("o")).where("o.overlap is not null")
    after = edges.groupBy(group, F.col("a").alias("read")).agg(F.collect_list(F.struct("b", F.col("o.score").alias("score"), F.col("o.overlap").alias("overlap"))).alias("after"))

    def fold(rows: list[dict]) -> list[tuple]:
        at, texts = {r["read"]: i for i, r in enumerate(rows)}, [r["seq"] for r in rows]
        # an overlap that leaves nothing of the next read adds nothing to a path
        graph = [{at[e["b"]]: (e["score"], e["overlap"]) for e in r["after"] or ()} for r in rows]
        paths = heaviest_paths(graph, [True] * len(rows), [True] * len(rows))
        used = {i for p in paths for i in p}
        out = [spell(p, texts, graph) for p in paths] + [s for i, s in enumerate(texts) if i not in used]
        return [(rows[0][group], n, s) for n, s in enumerate(out)]

    rows = aligned.select(group, "read", "seq", "begin").join(after, [group, "read"], "left")
    return fold_groups(rows, [group], ["begin", "read"], fold, f"`{group}` {kind}, n int, seq string")


def scaffold(contigs: DataFrame, links: DataFrame, group: str, least: int, error: float) -> DataFrame:
    """group, n, seq: contigs (group, seq, begin) of which neighbours in order of begin (distinct in a group) are joined by links (group,
    link, seq), sequences that begin with the end of one and end with the beginning of the next. A link joins one pair of neighbours
    and a pair has one link: links choose in order of `link`, each the pair left that it overlaps best, of equals the first."""
    kind = contigs.schema[group].dataType.simpleString()
    order = Window.partitionBy(group).orderBy("begin")
    held = contigs.select(group, "seq", "begin").withColumns({"at": F.row_number().over(order), "next": F.lead("seq").over(order)})
    tries = held.where("next is not null").join(links.select(group, "link", F.col("seq").alias("between")), group)
    met = lambda a, b: suffix_prefix_columns(F.col(a), F.col(b), error, least)
    tries = tries.select(group, "at", "link", "between", met("seq", "between").alias("x"), met("between", "next").alias("y")).where("x.overlap is not null and y.overlap is not null")
    cut = tries.select(group, "at", "link", "between", (F.col("x.score") + F.col("y.score")).alias("score"), F.col("x.overlap").alias("before"), F.col("y.overlap").alias("behind")).where("score > 0")

    def choose(rows: list[dict]) -> list[tuple]:
        rows = sorted(rows, key=lambda r: (r["link"], -r["score"], r["at"]))
        chosen = set(greedy_pairs((-i, r["link"], r["at"]) for i, r in enumerate(rows)))
        return [(r[group], r["at"], r["between"], r["before"], r["behind"]) for r in rows if (r["link"], r["at"]) in chosen]

    joined = fold_groups(cut, [group], [], choose, f"`{group}` {kind}, at int, between string, before int, behind int")
    rows = held.join(joined.withColumn("at", F.col("at") + 1), [group, "at"], "left")  # a link belongs to the contig behind it
    rest = F.length("between") - F.col("before") - F.col("behind")
    piece = F.when(F.col("between").isNull(), F.col("seq")).otherwise(F.concat(F.substr("between", F.col("before") + 1, F.greatest(rest, F.lit(0))), F.substr("seq", F.greatest(-rest, F.lit(0)) + 1)))
    rows = rows.select(group, "at", piece.alias("piece"), F.sum(F.when(F.col("between").isNull(), 1).otherwise(0)).over(Window.partitionBy(group).orderBy("at")).cast("int").alias("n"))
    whole = rows.groupBy(group, "n").agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("p"))
    return whole.select(group, (F.col("n") - 1).alias("n"), F.array_join(F.col("p.piece"), "").alias("seq"))


def _on_text(seqs: DataFrame, texts: DataFrame, group: str) -> DataFrame:
    """Sequences (group, n, seq) with begin and end on the text; whole: aligned without more clipped than padding would hide."""
    found = lay(texts, seqs, group, "text", "n", "seq").select(group, "n", "begin", "end", _unclipped().alias("whole"))
    return seqs.join(found, [group, "n"], "left").withColumn("whole", F.coalesce("whole", F.lit(False)))


def guided_contigs(texts: DataFrame, reads: DataFrame, group: str, least: int, error: float, read_len: int, tables: Scratch, longest: int = 1024) -> DataFrame:
    """group, seq, begin, end: contigs of the reads along each group's text, which overlap nowhere on it.

    texts: group and text. reads: group, read (unique in its group), layer (1 to 3: left, between, right) and seq; null and empty ones
    take no part, nor do groups without an accepted read. A group's reads are bounded by the caller; longest bounds a read's stretch.
    Reads that align from end to end become contigs; of these the better ones that align unclipped and do not overlap stay.
    Neighbours are joined by what the other reads assemble to, unless a joined sequence then does not align or overlaps another."""
    reads = reads.where(F.length("seq") > 0).select(group, "read", "layer", "seq")
    aligned = tables.table(_aligned(reads, texts, group), "guided-aligned")
    good = F.coalesce("accepted", F.lit(False))
    paths = tables.table(_paths(aligned.where(good), group, least, error, longest), "guided-paths")
    laid = _on_text(paths, texts, group).where("whole")
    kept = tables.table(retain_disjoint(laid, [group], "begin", "end", ["n"]).select(group, "n", "seq", "begin", "end"), "guided-kept")
    many = kept.groupBy(group).agg(F.count("*").alias("c")).where("c > 1").select(group)
    spare = aligned.where(~good).join(many, group, "left_semi")
    links = assemble_groups(spare, group, "seq", "layer", ["layer", "read"], least, read_len).where("contig >= 0").select(group, F.col("contig").alias("link"), "seq")
    links = tables.table(links, "guided-links")
    joined = tables.table(_on_text(scaffold(kept.join(links.select(group).distinct(), group, "left_semi"), links, group, least, error), texts, group), "guided-joined")
    w = Window.partitionBy(group)
    reach = F.max("end").over(w.orderBy("begin", "n").rowsBetween(Window.unboundedPreceding, -1))
    apart = joined.withColumn("ok", F.col("whole") & F.coalesce(F.col("begin") > reach, F.lit(True)))
    sound = apart.groupBy(group).agg(F.bool_and("ok").alias("ok")).where("ok").select(group)
    return kept.join(sound, group, "left_anti").select(group, "seq", "begin", "end").unionByName(joined.join(sound, group, "left_semi").select(group, "seq", "begin", "end"))


def patched(texts: DataFrame, contigs: DataFrame, group: str) -> DataFrame:
    """texts (group, text, left_at and right_at: the breakpoints' places) with contigs, which do not overlap, put in their places:
    text is corrected, left_precise and right_precise say whether a contig holds FLANK letters on both sides of a breakpoint."""
    lists = contigs.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("begin", "end", "seq"))).alias("cs"))
    part = lambda s, c: F.struct(F.concat(s["out"], F.substr(F.col("text"), s["at"] + 1, F.greatest(c["begin"] - s["at"], F.lit(0))), c["seq"]).alias("out"), (c["end"] + 1).alias("at"))
    spelt = F.aggregate("cs", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), part, lambda s: F.concat(s["out"], F.substr(F.col("text"), s["at"] + 1)))
    holds = lambda at: F.coalesce(F.exists("cs", lambda c: (c["begin"] < F.col(at) - FLANK) & (c["end"] >= F.col(at) + FLANK)), F.lit(False))
    rest = [c for c in texts.columns if c not in ("text", "left_at", "right_at")]
    return texts.join(lists, group, "left").select(*rest, F.when(F.col("cs").isNull(), F.col("text")).otherwise(spelt).alias("text"), holds("left_at").alias("left_precise"), holds("right_at").alias("right_precise"))
