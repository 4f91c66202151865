"""Sources, and the small-insertion plan on reads simulated over a planted insertion."""

import random
import struct
import zlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from spanloom.operators import consensus
from spanloom.plans import insertions
from spanloom.plans.config import Config
from spanloom.sources import sam, text


@pytest.fixture(scope="module")
def planted():
    draw = random.Random(11)
    ref = "".join(draw.choice("ACGT") for _ in range(4000))
    extra = "".join(draw.choice("ACGT") for _ in range(60))
    at = 2000
    donor = ref[:at] + extra + ref[at:]
    reads = []
    for n in range(600):
        s = draw.randint(0, len(donor) - 100)
        seq = donor[s : s + 100]
        left, right = max(0, min(at - s, 100)), max(0, min(s + 100 - at - 60, 100))
        if left == 100:
            pos, cigar = s, "100M"
        elif right == 100:
            pos, cigar = s - 60, "100M"
        elif left >= right and left > 30:
            pos, cigar = s, f"{left}M{100 - left}S"
        elif right > 30:
            pos, cigar = at, f"{100 - right}S{right}M"
        else:
            continue
        reads.append((f"q{n}", draw.choice([0, 16]), pos, cigar, seq, "I" * 100))
    return ref, at, extra, reads


def sam_text(ref, reads):
    lines = ["@HD\tVN:1.6", f"@SQ\tSN:c\tLN:{len(ref)}"]
    return "\n".join(lines + [f"{q}\t{f}\tc\t{p + 1}\t60\t{c}\t=\t1\t0\t{s}\t{x}\tMC:Z:100M\tMQ:i:60\tNM:i:0" for q, f, p, c, s, x in reads]) + "\n"


def bam_bytes(ref, reads, block):
    """The same records as a BAM file with small blocks."""
    data = b"BAM\1" + struct.pack("<i", 4) + b"@HD\n" + struct.pack("<ii", 1, 2) + b"c\0" + struct.pack("<i", len(ref))
    for q, f, p, c, s, x in reads:
        ops, n = [], ""
        for ch in c:
            if ch.isdigit():
                n += ch
            else:
                ops.append(int(n) << 4 | "MIDNSHP=X".index(ch))
                n = ""
        codes = ["=ACMGRSVTWYHKDBN".index(b) for b in s] + [0] * (len(s) % 2)
        body = struct.pack("<iiBBHHHiiii", 0, p, len(q) + 1, 60, 0, len(ops), f, len(s), 0, 0, 0) + q.encode() + b"\0" + struct.pack(f"<{len(ops)}I", *ops)
        body += bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(codes), 2)) + bytes(ord(b) - 33 for b in x) + b"MCZ100M\0MQC\x3cNMC\0"
        data += struct.pack("<i", len(body)) + body
    out = b""
    for i in [*range(0, len(data), block), None]:
        part = b"" if i is None else data[i : i + block]
        pack = zlib.compressobj(6, zlib.DEFLATED, -15)
        deflated = pack.compress(part) + pack.flush()
        out += b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(deflated) + 25) + deflated + struct.pack("<II", zlib.crc32(part), len(part))
    return out


def test_sources_agree(spark, tmp_path, planted):
    ref, _, _, reads = planted
    (tmp_path / "a.sam").write_text(sam_text(ref, reads))
    columns = sam.COLUMNS[2:]
    want = sorted(map(tuple, sam.read_sam(spark, str(tmp_path / "a.sam")).select(*columns).collect()), key=repr)
    assert len(want) == len(reads)
    spark.dataSource.register(sam.BamDataSource)
    for block, size in ((60_000, 1), (5_003, 1), (5_003, 1 << 30), (700, 4_000)):
        (tmp_path / "a.bam").write_bytes(bam_bytes(ref, reads, block))
        found = spark.read.format("bam").option("splitBytes", size).load(str(tmp_path / "a.bam"))
        assert sorted(map(tuple, found.select(*columns).collect()), key=repr) == want
        assert [r["qname"] for r in found.orderBy("file_ord").collect()] == [r[0] for r in reads]


def test_reference_regions_and_variants(spark, tmp_path):
    seqs = {"x": "ACGTacgtN" * 50, "y": "TTGA"}
    (tmp_path / "r.fa").write_text("".join(f">{k} note\n" + "\n".join(v[i : i + 60] for i in range(0, len(v), 60)) + "\n" for k, v in seqs.items()))
    ref = text.read_fasta(spark, str(tmp_path / "r.fa"), chunk=64)
    chunks = {(r["contig"], r["chunk_id"]): r["chunk"] for r in ref.collect()}
    assert {k: "".join(chunks[k, i] for i in range(-(-len(v) // 64))) for k, v in seqs.items()} == seqs
    lengths = text.contig_lengths(ref)
    assert {r["contig"]: r["length"] for r in lengths.collect()} == {"x": 450, "y": 4}
    (tmp_path / "r.bed").write_text("x\ny\t1\t3\n")
    assert sorted(map(tuple, text.read_regions(spark, str(tmp_path / "r.bed"), lengths, 10).collect())) == [("x", 10, 440), ("y", 1, 3)]
    (tmp_path / "v.vcf").write_text("##x\n#CHROM\nx\t5\tid\tA\t<INS>\t.\tSMALL;B\tEND=7;IMPRECISE\tGT\t1\n")
    v = text.read_vcf(spark, str(tmp_path / "v.vcf")).first()
    assert (v["pos"], v["filter"], v["info"]) == (4, ["SMALL", "B"], {"END": "7", "IMPRECISE": None})


def test_planted_insertion_is_called(spark, tmp_path, planted):
    ref, at, extra, reads = planted
    (tmp_path / "a.sam").write_text(sam_text(ref, reads))
    chunks = spark.createDataFrame([("c", i, ref[i * 500 : (i + 1) * 500]) for i in range(8)], "contig string, chunk_id long, chunk string")
    config = Config(min_insertion_size=50, read_len=100)
    calls = insertions.annotate_filters(insertions.small_insertions(sam.read_sam(spark, str(tmp_path / "a.sam")), chunks, config, 500), config).cache()
    (call,) = calls.collect()
    # the insertion may be placed anywhere among equal placements: it must give back the donor
    assert ref[: call["start"] + 1] + call["seq"] + ref[call["end"] + 1 :] == ref[:at] + extra + ref[at:]
    assert call["id"] == "S_INS_0" and call["filter"] == ["PASS"]
    line = insertions.vcf_lines(calls, chunks, 500).first()["line"].split("\t")
    assert line[:2] == ["c", str(call["start"] + 1)] and line[3] == ref[call["start"]] and f"SVINSSEQ={call['seq']}" in line[7]
    none = insertions.small_insertions(sam.read_sam(spark, str(tmp_path / "a.sam")).where(~F.col("cigar").contains("S")), chunks, config, 500)
    assert none.count() == 0


def test_command_line_writes_variant_files(spark, tmp_path, planted):
    import glob
    import gzip

    from spanloom.__main__ import main

    ref, at, extra, reads = planted
    (tmp_path / "a.sam").write_text(sam_text(ref, reads))
    (tmp_path / "r.fa").write_text(">c\n" + ref + "\n")
    main([str(tmp_path / "a.sam"), str(tmp_path / "r.fa"), str(tmp_path / "out"), "--min-insertion-size", "50"], spark)
    lines = [x for p in sorted(glob.glob(f"{tmp_path}/out/all.vcf/part-*.gz")) for x in gzip.open(p, "rt").read().splitlines()]
    assert lines[0] == "##fileformat=VCFv4.2" and "##contig=<ID=c,length=4000>" in lines and lines[-2].startswith("#CHROM")
    fields = lines[-1].split("\t")
    info = dict(x.split("=", 1) for x in fields[7].split(";"))
    assert ref[: int(fields[1])] + info["SVINSSEQ"] + ref[int(info["END"]) :] == ref[:at] + extra + ref[at:]
    passed = [x for p in sorted(glob.glob(f"{tmp_path}/out/pass.vcf/part-*.gz")) for x in gzip.open(p, "rt").read().splitlines()]
    assert passed == (lines if fields[6] == "PASS" else lines[:-1])


def test_filters_judge_the_depth_of_the_flanks(spark, tmp_path, planted):
    ref, _, _, reads = planted
    (tmp_path / "a.sam").write_text(sam_text(ref, reads))
    chunks = spark.createDataFrame([("c", i, ref[i * 500 : (i + 1) * 500]) for i in range(8)], "contig string, chunk_id long, chunk string")
    config = Config(min_insertion_size=50, read_len=100)
    rows = sam.read_sam(spark, str(tmp_path / "a.sam"))
    calls = insertions.small_insertions(rows, chunks, config, 500).cache()
    for depth, filters in (((1, 1000), ["PASS"]), ((100, 1000), ["ANOMALOUS_DEPTH"]), ((0, 2), ["ANOMALOUS_DEPTH", "ANOMALOUS_SC_NUMBER"])):
        (call,) = insertions.annotate_filters(calls, config, depth, rows).collect()
        assert sorted(call["filter"]) == filters and 2 < call["left_depth"] < 100 and 2 < call["right_depth"] < 100
    bounds = lambda *own: spark.createDataFrame([*own, (".", 1, 1000, 30)], "contig string, low long, high long, median long")
    for own, filters in ((bounds(("c", 100, 1000, 500)), ["ANOMALOUS_DEPTH"]), (bounds(("d", 100, 1000, 500)), ["PASS"]), (bounds().limit(0), ["PASS"])):
        (call,) = insertions.annotate_filters(calls, config, own, rows).collect()
        assert (call["filter"], "__low" in call.asDict()) == (filters, False)


def test_depth_bounds_by_contig(spark):
    """The hundredth values and medians of each contig's covered positions, and of all together."""
    draw = random.Random(8)
    spans = [(c, 0, a, f"{draw.randint(20, 60)}M") for c, n in (("a", 400), ("b", 30)) for a in draw.choices(range(300), k=n)]
    places = [(c, p) for c in "abz" for p in range(0, 340, 3)]
    found = insertions.depth_bounds_by_contig(spark.createDataFrame(spans, "contig string, flag int, pos long, cigar string"), spark.createDataFrame(places, "contig string, pos long"))
    depths = {c: sorted(d for p in range(0, 340, 3) if (d := sum(k == c and a <= p < a + int(m[:-1]) for k, _, a, m in spans))) for c in "ab"}
    depths["."] = sorted(depths["a"] + depths["b"])
    want = {c: (v[len(v) // 100], v[min(len(v) - len(v) // 100, len(v) - 1)], v[len(v) // 2]) for c, v in depths.items()}
    assert {r["contig"]: (r["low"], r["high"], r["median"]) for r in found.collect()} == want


def test_reads_are_laid_out_behind_indels_of_the_first():
    assert [consensus.indel_shift("10S20M5I20M10D30M", n) for n in (0, 30, 31, 50, 55, 60, 99)] == [0, 0, 5, 5, 0, -5, -5]
    draw = random.Random(12)
    donor = "".join(draw.choice("ACGT") for _ in range(200))
    shape = {"lclip": 0, "rclip": 20, "reverse": False, "qual": "I" * 100}
    # 5 bases of the donor from its place 30 on are inserted; later reads start behind them
    rows = [{"qname": "a", "start": 0, "ustart": 0, "end": 75, "uend": 95, "cigar": "30M5I45M20S", "seq": donor[:100], **shape}]
    rows += [{"qname": f"b{i}", "start": s - 5, "ustart": s - 5, "end": s + 75, "uend": s + 95, "cigar": "80M20S", "seq": donor[s : s + 100], **shape} for i, s in enumerate((40, 42, 44, 46))]
    found = consensus.clip_consensus(pd.DataFrame(rows), "R", 0.04)
    assert found is not None and found["fwd_clipped"] == 5 and found["seq"] == donor[42:142]


def test_config():
    assert Config.parse("seed 3\nmax_is 700\nmax_is 900\nper_contig_stats 1\nother x\n") == Config(seed=3, max_is=900, per_contig_stats=True)
