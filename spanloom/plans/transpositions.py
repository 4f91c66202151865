"""Transposed and assembled insertions from discordant reads, as a plan of tables.

Reads with a stable end and their mates' sequences become clusters, and right and left clusters pairs. A pair's mates point at
regions of the reference; all are scored, the best one is chosen, and pairs that their own surroundings explain as well are given
up. The region's sequence between both flanks is what the sample should look like there; contigs of the reads that fit correct it.
Reads are aligned to it again, and it is placed on the reference. Pairs without a region, or most of whose reads do not fit, are assembled from their reads instead.

Every step is a table over cluster pairs or their reads. Python works on one pair's few texts at a time: a pair has fewer than
MOST_READS reads, and its texts span its reads and a region.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import alignments as A
from spanloom.functions.align import HARSH, PADDING, TO_BASE, align, suffix_prefix
from spanloom.functions.sequences import reverse_complement
from spanloom.functions.vcf import record_line
from spanloom.operators import annotate, placement, remap
from spanloom.operators.assembly import MOST_READS
from spanloom.operators.calls import insertion_filters, keep_first, sequential_ids
from spanloom.operators.clustering import agglomerative_clusters, anchored_clusters
from spanloom.operators.guided import guided_contigs, lay, patched
from spanloom.operators.reference import with_reference
from spanloom.operators.scoring import best_regions, score_regions
from spanloom.operators.seeds import seed_index
from spanloom.plans.config import Config
from spanloom.plans.insertions import CHUNK, clip_consensuses, with_depth_bounds
from spanloom.shared import Scratch
from spanloom.sources.text import contig_lengths

#: Reads of a side that score the regions of a crowded pair first, the regions that stay then, how far the reference is
#: looked at around a pair when its sequence is placed.
SAMPLE, CANDIDATES, AROUND = 15, 3, 50
#: The clip's id among a pair's members; reads have theirs from 0 on.
_CLIP = -1


def cluster_pairs(reads: DataFrame, reference: DataFrame, config: Config, tables: Scratch) -> tuple[DataFrame, DataFrame]:
    """pairs: cluster, contig, r_start, r_end, l_start, l_end, reads; and their members: cluster, side, member, clip, start, end, nm,
    seq (the read's own; of a clip its whole consensus), mate_seq (of a clip its clipped part), mate_qual, mate_contig, mate_pos,
    mate_reverse, mate_mapped, fwd and rev (reads of a clip)."""
    stable = tables.table(annotate.stable_with_mates(reads, config.min_stable_mapq, config.min_clip_len).withColumn("member", F.monotonically_increasing_id()), "stable")
    clips = clip_consensuses(reads, config, contig_lengths(reference))
    left = F.col("side") == "L"
    part = F.when(left, F.expr("left(seq, cast(breakpoint - start as int))")).otherwise(F.expr("right(seq, cast(end - breakpoint as int))"))
    clips = clips.select(
        "contig", "side", F.when(left, F.col("breakpoint")).otherwise(F.col("start")).alias("start"), F.when(left, F.col("end")).otherwise(F.col("breakpoint")).alias("end"), "seq", part.alias("mate_seq"),
        F.col("fwd_clipped").alias("fwd"), F.col("rev_clipped").alias("rev"),
    )
    clips = tables.table(clips, "clips")
    spans = stable.select("contig", "side", "start", "end", F.lit(0).alias("clips")).unionByName(clips.select("contig", "side", "start", "end", (F.col("fwd") + F.col("rev")).alias("clips")))
    spans = spans.groupBy("contig", "side", "start", "end").agg(F.max("clips").alias("clips"))
    grouped = agglomerative_clusters(spans, ["contig", "side"], "start", "end", config.max_is, clips="clips", side="side", slack=config.max_clipped_pos_dist)
    ids = tables.table(grouped.select("contig", "side", "island", "cluster").distinct().withColumn("id", F.monotonically_increasing_id()), "ids")
    of = tables.table(grouped.join(ids, ["contig", "side", "island", "cluster"]).select("contig", "side", "start", "end", "id"), "of")
    where = ["contig", "side", "start", "end"]
    held = stable.join(of, where)
    best = clips.join(of, where).withColumn("sc", F.col("fwd") + F.col("rev"))
    best = remap.best_by(best, ["id"], "sc", ["start", "end", "seq"], ["start", "end", "seq", "mate_seq", "fwd", "rev"])
    extent = held.groupBy("id", "contig", "side").agg(F.min("start").alias("rs"), F.max("end").alias("re"), F.count("*").alias("members")).where("members > 1")
    bounded = extent.join(best.select("id", F.col("start").alias("cs"), F.col("end").alias("ce")), "id", "left")
    low, high = remap.cluster_bounds(F.col("side"), F.col("rs"), F.col("re"), F.col("cs"), F.col("ce"))
    clusters = tables.table(bounded.select("id", "contig", "side", low.alias("start"), high.alias("end"), "members"), "clusters")
    matched = annotate.matched_clusters(clusters.where("side = 'R'"), clusters.where("side = 'L'"), config.max_is)
    side = lambda s: clusters.select(F.col("id").alias(s), "contig", F.col("start").alias(f"{s}_start"), F.col("end").alias(f"{s}_end"), F.col("members").alias(f"{s}_n"))
    pairs = matched.select("r", "l").join(side("r"), "r").join(side("l").drop("contig"), "l").withColumn("reads", F.col("r_n") + F.col("l_n")).where(F.col("reads") <= MOST_READS)
    pairs = tables.table(pairs.select(F.col("r").alias("cluster"), "r", "l", "contig", "r_start", "r_end", "l_start", "l_end", "reads"), "pairs")
    sides = pairs.select("cluster", F.col("r").alias("id")).unionByName(pairs.select("cluster", F.col("l").alias("id")))
    columns = ["start", "end", "nm", "seq", "mate_seq", "mate_qual", "mate_contig", "mate_pos", "mate_reverse", "mate_mapped"]
    own = held.join(sides, "id").select("cluster", "side", "member", F.lit(False).alias("clip"), *columns, F.lit(0).alias("fwd"), F.lit(0).alias("rev"))
    turned = best.join(clusters.select("id", "side"), "id").join(sides, "id").select("cluster", "side", F.lit(_CLIP).cast("long").alias("member"), F.lit(True).alias("clip"), "start", "end", "seq", "mate_seq", "fwd", "rev")
    return pairs, tables.table(own.unionByName(turned, allowMissingColumns=True), "members")


def candidate_regions(members: DataFrame, lengths: DataFrame, config: Config, tables: Scratch) -> DataFrame:
    """cluster, region, contig, low, high: where a pair's mates lie, by runs of them within an insert from the first one."""
    mapped = members.where("mate_mapped and mate_contig is not null")
    runs = anchored_clusters(mapped.select("cluster", "mate_contig", "mate_pos", "member", "mate_reverse"), ["cluster", "mate_contig"], "mate_pos", "member", config.max_is)
    runs = runs.join(lengths.select(F.col("contig").alias("mate_contig"), "length"), "mate_contig")
    found = remap.mate_regions(runs, ["cluster", "mate_contig", "anchor"], "mate_pos", "mate_reverse", "length", config.max_is, config.max_trans_size)
    return tables.table(found.select("cluster", F.monotonically_increasing_id().alias("region"), F.col("mate_contig").alias("contig"), "low", "high"), "regions")


def stitch(left: str, inserted: str, right: str, least: int) -> str:
    """The three in a row; what one ends with and the next begins with stands there once. An overlap is ungapped, of `least` letters
    or more, else what of the next one aligns to the end of the one before from its first letter on."""

    def shared(a: str, b: str) -> int:
        met = suffix_prefix(a, b, 1, -4, 1.0, least)
        if met is not None and met[1] > 0:
            return met[0]
        found = align(b, a, TO_BASE)
        return found.query_end if found is not None and found.query_begin == 0 and found.ref_end == len(a) - 1 else 0

    return left + inserted[shared(left, inserted) :] + right[shared(inserted, right) :]


def _junctions(texts: DataFrame, least: int) -> DataFrame:
    """texts: cluster, left, inserted, right. cluster and junction."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"cluster": frame["cluster"], "junction": [stitch(r.left.upper(), r.inserted.upper(), r.right.upper(), least) for r in frame.itertuples(index=False)]})

    return texts.select("cluster", "left", "inserted", "right").mapInPandas(run, "cluster long, junction string")


def realigned(members: DataFrame, junctions: DataFrame, config: Config, least_quality: int = 0) -> DataFrame:
    """cluster, side, member, clip and ok: whether the member (of reads the mate, of clips the whole consensus) aligns to the junction
    from end to end with few mismatches. A junction goes once to all members of its pair."""
    pad = F.lit("N" * PADDING)
    right = F.col("side") == "R"
    text = F.when(F.col("clip"), F.col("seq")).when(right, reverse_complement(F.col("mate_seq"))).otherwise(F.col("mate_seq"))
    quality = F.when(~F.col("clip"), F.when(right, F.reverse("mate_qual")).otherwise(F.col("mate_qual")))
    own = F.concat_ws(":", "side", "member")
    found = lay(junctions, members.select("cluster", own.alias("of"), F.concat(pad, text, pad).alias("q")), "cluster", "junction", "of", "q", HARSH)
    found = found.join(members.select("cluster", "side", "member", "clip", own.alias("of"), quality.alias("quality")), ["cluster", "of"])
    ok = A.accepts(F.col("cigar"), F.col("query_begin"), F.col("query_end"), F.col("mismatches"), config.max_seq_error, F.col("quality"), least_quality)
    return found.select("cluster", "side", "member", "clip", ok.alias("ok"))


def _support(judged: DataFrame, members: DataFrame) -> DataFrame:
    """cluster, r_disc, l_disc (mates that fit), r_fwd, r_rev, l_fwd, l_rev (reads of clips that fit), r_nm, l_nm (mean mismatches)."""
    rows = judged.where("ok").join(members.select("cluster", "side", "member", "nm", "fwd", "rev"), ["cluster", "side", "member"])
    out = []
    for s in "RL":
        mine, p = F.col("side") == s, s.lower()
        out += [F.count_if(mine & ~F.col("clip")).alias(f"{p}_disc"), F.coalesce(F.sum(F.when(mine & F.col("clip"), F.col("fwd"))), F.lit(0)).cast("int").alias(f"{p}_fwd"), F.coalesce(F.sum(F.when(mine & F.col("clip"), F.col("rev"))), F.lit(0)).cast("int").alias(f"{p}_rev"), F.avg(F.when(mine & ~F.col("clip"), F.col("nm"))).alias(f"{p}_nm")]
    return rows.groupBy("cluster").agg(*out)


def discordant_insertions(reads: DataFrame, reference: DataFrame, config: Config, chunk: int = CHUNK, least_quality: int = 0) -> DataFrame:
    """The calls: id (T_INS_n transposed, A_INS_n assembled), kind, contig, start, end, seq, anchors and their CIGARs, support of both
    sides, and of transposed ones where the sequence comes from: source, source_start, source_end and source_reverse, and precise:
    whether reads' own consensus holds both breakpoints.

    reads: the columns of an alignment source; reference: contig, chunk_id, chunk (of `chunk` bases)."""
    tables = Scratch(reads.sparkSession, "discordant", light=True)
    lengths = tables.table(contig_lengths(reference), "lengths")
    pairs, members = cluster_pairs(reads, reference, config, tables)
    regions = candidate_regions(members, lengths, config, tables)
    index = tables.table(seed_index(reference, chunk), "index")
    placing = members.select("cluster", "side", "member", "clip", F.col("mate_seq").alias("seq"))
    score = lambda m, r, name, **kw: score_regions(m, r, reference, config.max_is, chunk, tables, name, index=index, least_clip=config.min_clip_len, **kw)

    # Where there are many reads and many regions, a sample of the reads says which regions all are placed in.
    crowded = regions.groupBy("cluster").agg(F.count("*").alias("n")).where(f"n > {CANDIDATES}").join(pairs.where(f"reads > {2 * SAMPLE}"), "cluster").select("cluster")
    crowded = tables.table(crowded, "crowded")
    drawn = Window.partitionBy("cluster", "side", "clip").orderBy(F.xxhash64("member", F.lit(config.seed)), "member")
    sample = placing.join(crowded, "cluster", "left_semi").withColumn("k", F.row_number().over(drawn)).where(F.col("clip") | (F.col("k") <= SAMPLE)).drop("k")
    rough, _ = score(sample, regions.join(crowded, "cluster", "left_semi"), "rough-")
    few = best_regions(rough, regions, CANDIDATES).select(*regions.columns).unionByName(regions.join(crowded, "cluster", "left_anti"))
    few = tables.table(few, "few")
    mapped = placing.join(few.select("cluster"), "cluster", "left_semi")
    scores, placed = score(mapped, few, "all-")
    best = tables.table(best_regions(scores, few), "best")

    # The pair's own surroundings, where N matches all.
    around = pairs.join(lengths, "contig").join(few.select("cluster"), "cluster", "left_semi")
    own = around.select("cluster", F.lit(_CLIP).cast("long").alias("region"), "contig", F.greatest(F.col("r_start") - config.max_is, F.lit(0)).alias("low"), F.least(F.col("l_end") + config.max_is, "length").alias("high")).where("high > low")
    own_scores, own_placed = score(mapped, tables.table(own, "own-regions"), "own-", scoring=TO_BASE)
    home = best_regions(own_scores, own).select("cluster", F.col("rc"), F.col("total").alias("own_total"))
    fits = own_placed.join(home.select("cluster", "rc"), ["cluster", "rc"]).groupBy("cluster").agg(F.count_if("accepted").alias("own_accepted"))
    told = best.join(home.drop("rc"), "cluster", "left").join(fits, "cluster", "left")
    explained = remap.explained_by_own_region(F.coalesce("own_total", F.lit(0)), F.col("total"), F.coalesce("own_accepted", F.lit(0)), F.col("reads"))
    chosen = tables.table(told.where(~explained).select(*best.columns), "chosen")

    # What the sample should look like: flanks as far as the reads that fit reach, the region between them.
    good = placed.join(chosen.select("cluster", "region", "rc"), ["cluster", "region", "rc"]).where("accepted").select("cluster", "side", "member")
    ends = good.join(members, ["cluster", "side", "member"]).groupBy("cluster", "side").agg(
        F.min(F.when(~F.col("clip"), F.col("start"))).alias("rs"), F.max(F.when(~F.col("clip"), F.col("end"))).alias("re"), F.min(F.when(F.col("clip"), F.col("start"))).alias("cs"), F.max(F.when(F.col("clip"), F.col("end"))).alias("ce")
    )
    low, high = remap.cluster_bounds(F.col("side"), F.col("rs"), F.col("re"), F.col("cs"), F.col("ce"))
    ends = ends.select("cluster", "side", low.alias("a"), high.alias("b"))
    flank = lambda s, p: ends.where(F.col("side") == s).select("cluster", F.col("a").alias(f"{p}a"), F.col("b").alias(f"{p}b"))
    spans = chosen.where("first < last").join(flank("R", "r"), "cluster").join(flank("L", "l"), "cluster").where("rb > ra and lb > la").join(pairs.select("cluster", F.col("contig").alias("at")), "cluster")
    spans = tables.table(spans.select("cluster", "at", "contig", "rc", "first", "ra", "rb", "la", "lb", (F.col("last") + 1).alias("last")), "spans")
    texts = with_reference(spans, reference, ["cluster"], "at", "ra", "rb", "left", chunk)
    texts = with_reference(texts, reference, ["cluster"], "at", "la", "lb", "right", chunk)
    texts = with_reference(texts, reference, ["cluster"], "contig", "first", "last", "source", chunk)
    texts = texts.withColumn("inserted", F.when(F.col("rc"), reverse_complement(F.upper("source"))).otherwise(F.col("source")))
    plain = _junctions(texts, config.min_clip_len).join(spans.select("cluster", (F.col("rb") - F.col("ra") - 1).alias("rn"), (F.col("lb") - F.col("la") - 1).alias("ln")), "cluster")
    plain = plain.select("cluster", F.col("junction").alias("text"), F.col("rn").alias("left_at"), (F.length("junction") - F.col("ln")).alias("right_at"))
    plain = tables.table(plain, "plain")
    fitting = _oriented(members.join(good, ["cluster", "side", "member"], "left_semi"))
    contigs = guided_contigs(plain, fitting, "cluster", config.min_clip_len, config.max_seq_error, config.read_len, tables)
    junctions = tables.table(patched(plain, contigs, "cluster").withColumnRenamed("text", "junction"), "junctions")
    judged = tables.table(realigned(members, junctions, config, least_quality), "judged")

    # Pairs whose reads do not fit, and those that point nowhere, are assembled; what that does not solve stays transposed.
    counts = judged.groupBy("cluster").agg(F.count_if(F.col("ok") & (F.col("side") == "R")).alias("ro"), F.count_if(F.col("ok") & (F.col("side") == "L")).alias("lo"))
    kept = tables.table(pairs.join(chosen.select("cluster"), "cluster", "left_semi").unionByName(pairs.join(few.select("cluster"), "cluster", "left_anti")), "kept")
    doubtful = kept.join(counts, "cluster", "left").where(remap.wants_assembly(F.coalesce("ro", F.lit(0)), F.coalesce("lo", F.lit(0)), F.col("reads"))).select(*pairs.columns)
    assembled = tables.table(_assembled(tables.table(doubtful, "doubtful"), members, reference, lengths, config, chunk), "assembled")
    solved = assembled.where("status = 'OK'")

    window = pairs.join(lengths, "contig").join(junctions, "cluster").join(solved.select("cluster"), "cluster", "left_anti")
    window = window.withColumns({"low": F.greatest(F.col("r_start") - AROUND, F.lit(0)), "high": F.least(F.col("l_end") + AROUND, F.col("length") - 1)}).where("low < high").select("cluster", "contig", "low", "high", "junction")
    laid = with_reference(window, reference, ["cluster"], "contig", "low", "high", "ref", chunk).withColumn("seqs", F.array("junction"))
    moved = placement.place_sequences(laid.select("cluster", "contig", "low", "ref", "seqs"), "seqs", "ref", config.min_clip_len, config.min_insertion_size).where("status = 'OK'")
    shift = lambda c: F.concat((F.split_part(c, F.lit("-"), F.lit(1)).cast("long") + F.col("low")).cast("string"), F.lit("-"), (F.split_part(c, F.lit("-"), F.lit(2)).cast("long") + F.col("low")).cast("string"))
    columns = ["cluster", "contig", "start", "end", "seq", "left_anchor", "right_anchor", "left_anchor_cigar", "right_anchor_cigar"]
    moved = moved.withColumns({"start": F.col("start") + F.col("low"), "end": F.col("end") + F.col("low"), "left_anchor": shift(F.col("left_anchor")), "right_anchor": shift(F.col("right_anchor"))}).select(*columns)
    moved = moved.join(_support(judged, members), "cluster").where("r_disc + r_fwd + r_rev > 0 and l_disc + l_fwd + l_rev > 0")
    origin = chosen.select("cluster", F.col("contig").alias("source"), F.col("first").alias("source_start"), F.col("last").alias("source_end"), F.col("rc").alias("source_reverse"))
    exact = junctions.select("cluster", (F.col("left_precise") & F.col("right_precise")).alias("precise"))
    moved = moved.join(origin, "cluster").join(exact, "cluster").withColumn("kind", F.lit("T"))

    # Assembled sequences between their own flanks are what reads support.
    wide = solved.join(lengths, "contig").withColumns({"la": F.greatest(F.col("start") + 1 - config.max_is, F.lit(0)), "lb": F.col("start") + 1, "ra": F.col("end") + 1, "rb": F.least(F.col("end") + 1 + config.max_is, "length")})
    wide = with_reference(with_reference(wide, reference, ["cluster"], "contig", "la", "lb", "left", chunk), reference, ["cluster"], "contig", "ra", "rb", "right", chunk)
    spelt = wide.select("cluster", F.upper(F.concat("left", "seq", "right")).alias("junction"))
    built = solved.select(*columns).join(_support(realigned(members.join(solved.select("cluster"), "cluster", "left_semi"), spelt, config, least_quality), members), "cluster", "left").withColumn("kind", F.lit("A"))
    calls = tables.table(moved.unionByName(built.fillna(0, ["r_disc", "l_disc", "r_fwd", "r_rev", "l_fwd", "l_rev"]), allowMissingColumns=True).drop("cluster"), "calls")
    key = ["contig", "start", "end", "seq"]
    once = keep_first(calls, ["kind", *key], [F.desc(F.col("r_disc") + F.col("l_disc")), "left_anchor", "right_anchor"])
    return sequential_ids(once.where("kind = 'T'"), key, "T_INS_").unionByName(sequential_ids(once.where("kind = 'A'"), key, "A_INS_"))


def _oriented(members: DataFrame) -> DataFrame:
    """cluster, read, layer, member, seq: all texts of a pair's members as they lie along the junction. Layer 1 are reads and the clip of
    the right-clipped side, 2 mates, 3 reads and the clip of the other side."""
    right = F.col("side") == "R"
    name = lambda layer: F.concat_ws(":", layer, "side", F.lpad(F.col("member").cast("string"), 19, "0"))
    text = lambda layer, seq: members.select("cluster", "side", "clip", "member", layer.alias("layer"), name(layer.cast("string")).alias("read"), F.upper(seq).alias("seq"))
    own = text(F.when(right, 1).otherwise(3), F.col("seq"))
    mates = text(F.lit(2), F.when(right, reverse_complement(F.col("mate_seq"))).otherwise(F.col("mate_seq"))).where("not clip")
    return own.unionByName(mates).select("cluster", "read", "layer", "member", "seq")


def _assembled(doubtful: DataFrame, members: DataFrame, reference: DataFrame, lengths: DataFrame, config: Config, chunk: int) -> DataFrame:
    """What becomes of each pair's assembly (see placement.assembled_insertions). Reads of the right side come first, then mates, then
    reads of the left side; the reference goes with one row of a pair."""
    reach = 3 * config.max_is
    stretch = doubtful.join(lengths, "contig").withColumns({"low": F.greatest(F.least("r_end", "l_start") - reach, F.lit(0)), "high": F.least(F.greatest("r_end", "l_start") + reach, "length")})
    stretch = with_reference(stretch.select("cluster", "contig", "low", "high"), reference, ["cluster"], "contig", "low", "high", "ref", chunk)
    head = stretch.select("cluster", F.lit(None).cast("string").alias("seq"), F.lit(0).alias("layer"), F.lit(-2).cast("long").alias("member"), F.upper("ref").alias("ref"))
    mine = _oriented(members.join(doubtful.select("cluster"), "cluster", "left_semi")).drop("read")
    rows = head.unionByName(mine, allowMissingColumns=True).join(stretch.select("cluster", "contig", "low"), "cluster")
    return placement.assembled_insertions(rows, "cluster", ["layer", "member"], config.min_clip_len, config.read_len, config.min_insertion_size)


def annotate_filters(calls: DataFrame, reads: DataFrame, config: Config, depth: tuple[int, int] | DataFrame = (0, 1 << 30), median: int = 0) -> DataFrame:
    """Adds left_depth, right_depth (see annotate.flank_depths) and `filter`. depth: the least and largest usual depth; median: the
    usual one, of which support on one side should be a fifth; or those of each contig (see insertions.depth_bounds_by_contig). Remapping scores and the least number of pairs are not judged."""
    names = [*calls.columns, "left_depth", "right_depth"]
    calls = with_depth_bounds(annotate.flank_depths(calls, reads).fillna(0, ["left_depth", "right_depth"]), depth, median)
    split = {s: F.col(f"{s}_fwd") + F.col(f"{s}_rev") for s in "rl"}
    c = {
        "length": F.length("seq"), "start": F.col("start"), "end": F.col("end"), "seq": F.col("seq"), "left_depth": F.col("left_depth"), "right_depth": F.col("right_depth"), "min_depth": F.col("__low"), "max_depth": F.col("__high"),
        "left_split": split["r"], "right_split": split["l"], "global_max_depth": F.col("__most"), "left_disc": F.col("r_disc"), "right_disc": F.col("l_disc"), "left_support": F.col("r_disc") + split["r"], "right_support": F.col("l_disc") + split["l"],
        "median_depth": F.col("__median"), "left_score": F.lit(None).cast("double"), "right_score": F.lit(None).cast("double"), "mh_len": F.greatest(F.col("start") - F.col("end"), F.lit(0)), "min_pairs": F.lit(0),
    }
    found = {k: insertion_filters(k, c, config.min_insertion_size, config.read_len) for k in "TA"}
    return calls.select(*names, F.when(F.col("kind") == "T", found["T"]).otherwise(found["A"]).alias("filter"))


def vcf_lines(calls: DataFrame, reference: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """line: a variant record for each call, REF being the base at its start; contig, start and id for ordering. calls: with `filter`."""
    based = with_reference(calls.withColumn("next", F.col("start") + 1), reference, ["id"], "contig", "start", "next", "ref", chunk)
    length = F.length("seq")
    info = {
        "END": F.col("end") + 1, "SVTYPE": F.lit("INS"), "SVINSLEN": length, "SVLEN": length - (F.col("end") - F.col("start")), "SVINSSEQ": F.col("seq"), "ALGORITHM": F.when(F.col("kind") == "T", "transurveyor").otherwise("assembly"),
        "DISCORDANT": F.concat_ws(",", "r_disc", "l_disc"), "SPLIT_READS": F.concat_ws(",", F.col("r_fwd") + F.col("r_rev"), F.col("l_fwd") + F.col("l_rev")), "FWD_SPLIT_READS": F.concat_ws(",", "r_fwd", "l_fwd"), "REV_SPLIT_READS": F.concat_ws(",", "r_rev", "l_rev"),
        "LEFT_ANCHOR": F.col("left_anchor"), "RIGHT_ANCHOR": F.col("right_anchor"), "LEFT_ANCHOR_CIGAR": F.col("left_anchor_cigar"), "RIGHT_ANCHOR_CIGAR": F.col("right_anchor_cigar"),
        "IMPRECISE": (F.col("kind") == "T") & ~F.col("precise"),
    }
    return based.select("contig", "start", "id", record_line(F.col("contig"), F.col("start"), F.col("id"), F.upper("ref"), F.lit("<INS>"), F.col("filter"), info, {"IMPRECISE"}).alias("line"))
