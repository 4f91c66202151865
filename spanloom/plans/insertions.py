"""Small insertions from clipped reads: consensus of clip clusters, junctions of right and left consensuses, calls.

reads: the columns of an alignment source. reference: contig, chunk_id, chunk. All steps are DataFrames; only the consensus
of a cluster and the placement of a junction are Python, over groups that a cluster bounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions import align
from spanloom.functions import cigar as C
from spanloom.functions import flags as P
from spanloom.functions.vcf import header, record_line
from spanloom.operators.annotate import flank_depths
from spanloom.operators.calls import insertion_filters, keep_first, sequential_ids
from spanloom.operators.clustering import anchored_clusters
from spanloom.operators.consensus import clip_consensus
from spanloom.operators.grouped import fold_groups
from spanloom.operators.intervals import within_band
from spanloom.operators.reference import with_reference
from spanloom.operators.running import depth_at, order_statistics
from spanloom.operators.sampling import random_positions, whole_contigs
from spanloom.plans.config import Config
from spanloom.shared import Scratch
from spanloom.sources.text import contig_lengths

#: How far a left clip may lie before and behind the right clip of the same insertion.
BAND_BEFORE, BAND_AFTER = 100, 10
CHUNK = 65_536


def clipped_reads(reads: DataFrame, config: Config, lengths: DataFrame | None = None) -> DataFrame:
    """Primary mapped reads clipped on just one side (see flags.clip_side), with side, clip sizes and unclipped ends. lengths:
    contig and length; without them no contig has an end."""
    flag, cigar = F.col("flag"), F.col("cigar")
    left, right = C.left_clip(cigar), C.right_clip(cigar)
    rows = reads.where(P.is_primary(flag) & ~P.is_unmapped(flag))
    if lengths is None:
        rows = rows.withColumn("clen", F.lit(1 << 62))
    else:
        rows = rows.join(lengths.select("contig", F.col("length").alias("clen")), "contig", "left").fillna(1 << 62, ["clen"])
    rows = rows.withColumn("side", P.clip_side(F.col("pos"), cigar, F.col("clen"), config.min_clip_len)).where("side is not null").drop("clen")
    rows = rows.withColumns({"start": F.col("pos"), "end": C.end_position(F.col("pos"), cigar), "lclip": left, "rclip": right, "reverse": P.is_reverse(flag)})
    rows = rows.withColumns({"ustart": F.col("start") - F.col("lclip"), "uend": F.col("end") + F.col("rclip")})
    return rows.withColumn("at", F.when(F.col("side") == "L", F.col("start")).otherwise(F.col("end")))


def clip_consensuses(reads: DataFrame, config: Config, lengths: DataFrame | None = None) -> DataFrame:
    """contig, side, start, end, breakpoint, seq, fwd_clipped, rev_clipped of each cluster that agrees on a sequence."""
    clustered = anchored_clusters(clipped_reads(reads, config, lengths), ["contig", "side"], "at", "qname", config.max_clipped_pos_dist)
    rows = clustered.select("contig", "side", "anchor", "qname", "cigar", "start", "end", "ustart", "uend", "lclip", "rclip", "reverse", "seq", "qual")

    def fold(group: list[dict]) -> list[tuple]:
        found = clip_consensus(pd.DataFrame(group), group[0]["side"], config.max_seq_error)
        head = (group[0]["contig"], group[0]["side"])
        return [] if found is None else [(*head, *(found[k] for k in ("start", "end", "breakpoint", "seq", "fwd_clipped", "rev_clipped")))]

    return fold_groups(rows, ["contig", "side", "anchor"], ["qname"], fold, "contig string, side string, start long, end long, breakpoint long, seq string, fwd_clipped int, rev_clipped int")


def _homopolymer(seq: str) -> bool:
    counts = [seq.upper().count(b) for b in "ACGT"]
    return sum(counts) > 0 and max(counts) * 10 >= sum(counts) * 8


def junction(right_seq: str, left_seq: str, right_at: int, left_at: int, ref: str, ref_start: int, config: Config) -> dict | None:
    """Where the joined consensuses leave the reference and come back, and what lies between; None if it is no insertion."""
    met = align.suffix_prefix(right_seq, left_seq, 1, -4, config.max_seq_error, config.min_clip_len)
    if met is None or _homopolymer(left_seq[: met[0]]) or met[2] > met[0] * config.max_seq_error:
        return None
    pad = "N" * align.PADDING
    joined = pad + right_seq + left_seq[met[0] :] + pad
    size = len(joined)
    least = align.PADDING + config.min_clip_len
    low = max(0, right_at - size)
    before = ref[low - ref_start : right_at - ref_start]
    head = align.align(joined, before, align.TO_BASE)
    if head is None or head.query_begin != 0 or head.query_end - head.query_begin + 1 < least:
        return None
    rest = joined[head.query_end + 1 :]
    after = ref[right_at - ref_start : right_at - ref_start + size]
    tail = align.align(rest, after, align.TO_BASE)
    if tail is None or tail.query_end != len(rest) - 1 or tail.query_end - tail.query_begin + 1 < least:
        return None
    seq = rest[: tail.query_begin]
    if not seq or right_at - left_at >= len(seq) or "N" in seq:
        return None
    return {
        "start": low + head.ref_end, "end": right_at + tail.ref_begin - 1, "seq": seq, "overlap": met[0],
        "left_anchor": f"{low + head.ref_begin}-{low + head.ref_end}", "right_anchor": f"{right_at + tail.ref_begin}-{right_at + tail.ref_end}",
        "left_anchor_cigar": head.cigar, "right_anchor_cigar": tail.cigar,
    }


_FOUND = [("start", "long"), ("end", "long"), ("seq", "string"), ("overlap", "int"), ("left_anchor", "string"), ("right_anchor", "string"), ("left_anchor_cigar", "string"), ("right_anchor_cigar", "string")]


def small_insertions(reads: DataFrame, reference: DataFrame, config: Config, chunk: int = CHUNK) -> DataFrame:
    """Insertions whose two consensuses overlap, one row for each place and sequence, in coordinate order with ids S_INS_n."""
    found = clip_consensuses(reads, config, contig_lengths(reference))
    side = lambda s, p: found.where(F.col("side") == s).select("contig", *[F.col(c).alias(f"{p}_{c}") for c in ("breakpoint", "start", "seq", "fwd_clipped", "rev_clipped")])
    pairs = within_band(side("R", "r"), side("L", "l"), ["contig"], "r_breakpoint", "l_breakpoint", BAND_BEFORE, BAND_AFTER)
    reach = F.length("r_seq") + F.length("l_seq") + 2 * align.PADDING
    pairs = pairs.withColumns({"low": F.greatest(F.col("r_breakpoint") - reach, F.lit(0)), "high": F.col("r_breakpoint") + reach})
    placed = with_reference(pairs, reference, ["contig", "r_breakpoint", "r_start", "l_breakpoint", "l_start"], "contig", "low", "high", "ref", chunk)
    keep = ["contig", "r_fwd_clipped", "r_rev_clipped", "l_fwd_clipped", "l_rev_clipped"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            calls = [junction(r["r_seq"], r["l_seq"], r["r_breakpoint"], r["l_breakpoint"], r["ref"], r["low"], config) for r in rows]
            got = [(r, c) for r, c in zip(rows, calls, strict=True) if c is not None]
            kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
            yield pa.RecordBatch.from_arrays(
                [*[pa.array([r[k] for r, _ in got], pa.string() if k == "contig" else pa.int32()) for k in keep], *[pa.array([c[n] for _, c in got], kinds[t]) for n, t in _FOUND]], names=[*keep, *[n for n, _ in _FOUND]]
            )

    schema = "contig string, " + ", ".join(f"{k} int" for k in keep[1:]) + ", " + ", ".join(f"{n} {t}" for n, t in _FOUND)
    calls = placed.mapInArrow(run, schema)
    product = (F.col("r_fwd_clipped") + F.col("r_rev_clipped")) * (F.col("l_fwd_clipped") + F.col("l_rev_clipped"))
    # of equal calls the one with the smallest product of clipped reads stays, then the largest overlap
    once = keep_first(calls.withColumn("product", product), ["contig", "start", "end", "seq"], [F.col("product"), F.desc("overlap"), F.col("left_anchor"), F.col("right_anchor"), F.col("r_fwd_clipped"), F.col("l_fwd_clipped")])
    return sequential_ids(once.drop("product"), ["contig", "start", "end", "seq"], "S_INS_")


def annotate_filters(calls: DataFrame, config: Config, depth: tuple[int, int] | DataFrame = (0, 1 << 30), reads: DataFrame | None = None) -> DataFrame:
    """Adds `filter` to small calls, and with `reads` left_depth and right_depth too (see flank_depths).

    depth: the least and largest usual depth, or those of each contig (see depth_bounds_by_contig). Without reads depths are not known
    and ANOMALOUS_DEPTH is not judged."""
    zero = F.lit(0)
    names = calls.columns
    calls = with_depth_bounds(calls, depth)
    left, right = F.col("__low"), F.col("__low")
    if reads is not None:  # an anchor that no read covers has depth 0
        calls = flank_depths(calls, reads).fillna(0, ["left_depth", "right_depth"])
        names = [*names, "left_depth", "right_depth"]
        left, right = F.col("left_depth"), F.col("right_depth")
    c = {
        "length": F.length("seq"), "start": F.col("start"), "end": F.col("end"), "seq": F.col("seq"), "left_depth": left, "right_depth": right, "min_depth": F.col("__low"), "max_depth": F.col("__high"),
        "left_split": F.col("r_fwd_clipped") + F.col("r_rev_clipped"), "right_split": F.col("l_fwd_clipped") + F.col("l_rev_clipped"), "global_max_depth": F.col("__most"), "left_disc": zero, "right_disc": zero,
    }
    return calls.select(*names, insertion_filters("S", c, config.min_insertion_size, config.read_len).alias("filter"))


def depth_bounds(reads: DataFrame, positions: DataFrame) -> tuple[int, int]:
    """The usual depths over sampled positions (contig, pos) that reads cover: the values a hundredth of all above the least and
    below the largest. Every mapped read counts. (0, 2**30) if nothing is covered."""
    found = _usual(_covered(reads, positions), []).first()
    return (found["low"], found["high"]) if found else (0, 1 << 30)


#: Ranks of the usual depths.
_BOUNDS = {"low": "n div 100", "high": "n - n div 100", "median": "n div 2"}


def _usual(depths: DataFrame, keys: list[str]) -> DataFrame:
    return order_statistics(depths, keys, "depth", {name: F.expr(rank) for name, rank in _BOUNDS.items()})


def _covered(reads: DataFrame, positions: DataFrame) -> DataFrame:
    spans = reads.where(~P.is_unmapped(F.col("flag"))).select("contig", F.col("pos").alias("s"), C.end_position(F.col("pos"), F.col("cigar")).alias("e"))
    return depth_at(positions.withColumn("at", F.col("pos").cast("long")), spans, ["contig"], "at", "s", "e").where("depth > 0")


def depth_bounds_by_contig(reads: DataFrame, positions: DataFrame, default: str = ".") -> DataFrame:
    """contig, low, high, median: as depth_bounds, for each contig with a covered position and, as `default`, for all together."""
    depths = Scratch(reads.sparkSession, "depths", light=True).table(_covered(reads, positions).select("contig", "depth"), "depths")
    columns = ["contig", *_BOUNDS]
    own = _usual(depths, ["contig"]).select(*columns)
    return own.unionByName(_usual(depths, []).withColumn("contig", F.lit(default)).select(*columns))


def with_depth_bounds(calls: DataFrame, depth: tuple[int, int] | DataFrame, median: int = 0, default: str = ".") -> DataFrame:
    """Adds __low, __high and __median, the usual depths of a call's contig, or of all where it has none, and __most, the largest usual
    depth of all. Without any, depths are not bounded."""
    if not isinstance(depth, DataFrame):
        return calls.withColumns({"__low": F.lit(depth[0]), "__high": F.lit(depth[1]), "__most": F.lit(depth[1]), "__median": F.lit(median)})
    names = ["low", "high", "median"]
    own = depth.where(F.col("contig") != default).select("contig", *[F.col(n).alias(f"__o{n}") for n in names])
    rest = depth.where(F.col("contig") == default).agg(*[F.max(n).alias(f"__r{n}") for n in names])  # one row, also without a default
    both = {n: F.coalesce(F.col(f"__o{n}"), F.col(f"__r{n}"), F.lit(d)) for n, d in (("low", 0), ("high", 1 << 30), ("median", 0))}
    joined = calls.join(own, "contig", "left").join(F.broadcast(rest))
    return joined.select(*calls.columns, *[c.alias(f"__{n}") for n, c in both.items()], F.coalesce("__rhigh", F.lit(1 << 30)).alias("__most"))


def call_small_insertions(reads: DataFrame, reference: DataFrame, config: Config, seed: int = 0, sample: str = "1", command: str = "") -> tuple[DataFrame, list[str]]:
    """The whole path: usual depths over random positions, calls, filters, lines. Returns the lines (see vcf_lines) with `filter`,
    and the header; sources.files.write_vcf writes them."""
    lengths = {r["contig"]: r["length"] for r in contig_lengths(reference).collect()}  # a row for each contig
    places = reads.sparkSession.createDataFrame(random_positions(whole_contigs(dict(sorted(lengths.items()))), seed) or [("", 0)], "contig string, pos long")
    bounds = depth_bounds_by_contig(reads, places) if config.per_contig_stats else depth_bounds(reads, places)
    calls = annotate_filters(small_insertions(reads, reference, config), config, bounds, reads)
    lines = vcf_lines(calls, reference).join(calls.select("id", "filter"), "id")
    return lines, header(sorted(lengths.items()), sample, command)


def vcf_lines(calls: DataFrame, reference: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """line: a variant record for each call, REF being the base at its start; contig, start and id for ordering."""
    based = with_reference(calls.withColumn("next", F.col("start") + 1), reference, ["id"], "contig", "start", "next", "ref", chunk)
    length = F.length("seq")
    info = {
        "END": F.col("end") + 1, "SVTYPE": F.lit("INS"), "SVINSLEN": length, "SVLEN": length - (F.col("end") - F.col("start")), "SVINSSEQ": F.col("seq"), "OVERLAP": F.col("overlap"), "ALGORITHM": F.lit("consensus_overlap"),
        "SPLIT_READS": F.concat_ws(",", F.col("r_fwd_clipped") + F.col("r_rev_clipped"), F.col("l_fwd_clipped") + F.col("l_rev_clipped")), "FWD_SPLIT_READS": F.concat_ws(",", "r_fwd_clipped", "l_fwd_clipped"),
        "REV_SPLIT_READS": F.concat_ws(",", "r_rev_clipped", "l_rev_clipped"), "LEFT_ANCHOR": F.col("left_anchor"), "RIGHT_ANCHOR": F.col("right_anchor"), "LEFT_ANCHOR_CIGAR": F.col("left_anchor_cigar"), "RIGHT_ANCHOR_CIGAR": F.col("right_anchor_cigar"),
    }
    return based.select("contig", "start", "id", record_line(F.col("contig"), F.col("start"), F.col("id"), F.col("ref"), F.lit("<INS>"), F.col("filter"), info, set()).alias("line"))
