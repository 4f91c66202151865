"""BAM files: splits, indexes, regions, filters, and what is written read back."""

import io
import pathlib
import random
import shutil

import pytest
from pyspark.sql import functions as F

from spanloom.sources import bam, bam_index, bgzf
from spanloom.sources.bam import COLUMNS, BamReader, read_bam, write_bam

CONTIGS = [("z", 5_000_000), ("a", 900_000), ("none", 50)]
KEPT = COLUMNS[2:]


def made(n, seed=1):
    """Reads on two contigs, some unplaced, some clipped, a third of them at one position, one very long."""
    draw, rows = random.Random(seed), []
    for i in range(n):
        contig = draw.choice(["z", "z", "a", None])
        size = draw.choice([30, 60, 61]) if i else 70_000
        pos = -1 if contig is None else 123_456 if draw.random() < 0.3 else draw.randrange(850_000)
        seq = "".join(draw.choice("ACGTN") for _ in range(size))
        qual = None if i % 7 == 0 else "".join(chr(33 + draw.randrange(40)) for _ in range(size))
        cigar = None if contig is None else f"{size - 20}M2000N20M" if i % 11 == 0 else f"5S{size - 5}M"
        flag = 4 if contig is None else draw.choice([0, 16, 99, 147, 2048])
        rows.append((f"r{i}", flag, contig, pos, draw.randrange(61), cigar, draw.choice(["z", None]), draw.randrange(-1, 9), draw.randrange(-500, 500), seq, qual, "100M" if i % 3 else None, 60 if i % 2 else None, i % 5, None))
    return rows


@pytest.fixture(scope="module")
def rows():
    return made(3000)


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bam") / "reads")
    kinds = ", ".join(c for c in bam.SCHEMA.split(", ") if c.split()[0] in KEPT)
    write_bam(spark.createDataFrame(rows, kinds).withColumn("extra", F.lit(1)), path, CONTIGS, 4)
    return path


def values(df):
    return sorted(map(tuple, df.select(*KEPT).collect()), key=repr)


def covered(cigar):
    return max(1, bam._covered(bam._ops(cigar)))


def touches(row, regions):
    return any(row[2] == c and row[3] < (e if e is not None else 1 << 60) and row[3] + covered(row[5]) > s for c, s, e in regions)


def test_what_is_written_reads_back(spark, folder, rows):
    assert values(read_bam(spark, folder)) == sorted(rows, key=repr)
    ranks = {"z": 0, "a": 1, None: 3}
    places = [(ranks[r["contig"]], r["pos"]) for r in read_bam(spark, folder).orderBy("file", "file_ord").select("contig", "pos").collect()]
    assert places == sorted(places)


@pytest.mark.parametrize("regions", [
    [("z", 100_000, 130_000)], [("z", 123_456, 123_457), ("z", 100, 123_460), ("a", 0, 10)], [("a", 400_000, None)], [("z", 122_000, 122_001)],
    [("none", 0, None)], [("missing", 0, 9)], [("z", 5, 5)], [("z", -9, 1)], [],
])
def test_regions_are_those_of_a_full_scan(spark, folder, rows, regions):
    want = sorted((r for r in rows if touches(r, regions)), key=repr)
    assert values(read_bam(spark, folder, regions)) == want


def test_regions_without_an_index(spark, folder, rows, tmp_path):
    for f in pathlib.Path(folder).glob("*.bam"):
        shutil.copy(f, tmp_path / f.name)
    regions = [("z", 100_000, 130_000), ("a", 0, 9_000)]
    assert values(read_bam(spark, str(tmp_path), regions)) == sorted((r for r in rows if touches(r, regions)), key=repr)


def test_filters_are_pushed_and_stay_right(spark, folder, rows):
    found = read_bam(spark, folder).where((F.col("contig") == "z") & (F.col("pos") >= 300_000) & (F.col("pos") < 310_000) & (F.col("flag") != 16))
    assert values(found) == sorted((r for r in rows if r[2] == "z" and 300_000 <= r[3] < 310_000 and r[1] != 16), key=repr)
    both = read_bam(spark, folder, [("z", 300_000, 305_000)]).where(F.col("contig").isin("z", "a") & (F.col("pos") > 301_000))
    assert values(both) == sorted((r for r in rows if touches(r, [("z", 300_000, 305_000)]) and r[3] > 301_000), key=repr)
    assert values(read_bam(spark, folder).where(F.col("contig").isNull())) == sorted((r for r in rows if r[2] is None), key=repr)


def test_an_index_leaves_most_of_a_file_unread(folder):
    reader = BamReader({"path": folder, "regions": '[["z", 300000, 310000]]'})
    assert sum(max(1, (p.end >> 16) - (p.begin >> 16)) for p in reader.partitions()) < 0.2 * sum(p.size for p in BamReader({"path": folder}).partitions())


def one_file(rows, block=3_000):
    """A file with small blocks, and the virtual offsets of its records."""
    bgzf_block, bgzf.BLOCK = bgzf.BLOCK, block
    try:
        out = io.BytesIO()
        sink = bgzf.Writer(out)
        sink.write(bam.BamWriter({"path": "/x", "contigs": '[["z", 5000000], ["a", 900000], ["none", 50]]'}, True)._head())
        places = []
        for row in rows:
            data = bam._encoded(dict(zip(KEPT, row, strict=True)), {"z": 0, "a": 1, "none": 2}, 5)[-1]
            places.append(sink.tell())
            sink.write(data)
        sink.close()
        return out.getvalue(), places
    finally:
        bgzf.BLOCK = bgzf_block


@pytest.mark.parametrize("block", [300, 3_000, 60_000])
def test_records_are_found_from_any_byte(block):
    data, places = one_file(made(300), block)
    lengths = [n for _, n in CONTIGS]
    stream = io.BytesIO(data)
    assert bam.header(stream)[1] == places[0]
    assert [at for at, _ in bam.records(stream, places[0])] == places
    for start in range(1, len(data), 1499):
        want = next((p for p in places if p >> 16 >= start), len(data) << 16)
        assert bam.first_record(stream, start, len(data), lengths) == want


def test_splits_make_up_the_file(tmp_path):
    rows = made(400, 5)
    data, places = one_file(rows, 900)
    (tmp_path / "a.bam").write_bytes(data)
    for size in (2_000, 17_001, 1 << 40):
        reader = BamReader({"path": str(tmp_path / "a.bam")})
        reader.size = size
        found = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
        assert [r["file_ord"] for r in found] == places
        assert [tuple(r[c] for c in KEPT) for r in found] == rows


def test_a_cut_file_is_an_error(tmp_path):
    data, places = one_file(made(50), 900)
    whole = places[-1] >> 16
    for cut in (whole, whole + 30):
        (tmp_path / "a.bam").write_bytes(data[:cut])
        reader = BamReader({"path": str(tmp_path / "a.bam")})
        with pytest.raises(ValueError):
            list(reader.read(reader.partitions()[0]))


def test_empty_files_and_odd_rows(spark, tmp_path):
    kinds = ", ".join(c for c in bam.SCHEMA.split(", ") if c.split()[0] in KEPT)
    write_bam(spark.createDataFrame([], kinds), str(tmp_path / "e"), CONTIGS)
    assert read_bam(spark, str(tmp_path / "e")).count() == 0 and read_bam(spark, str(tmp_path / "e"), [("z", 0, None)]).count() == 0
    long = "1M1I" * 40_000  # more operations than a record's field counts
    odd = [(None,) * 15, ("q", 0, "z", 5, 9, long, None, None, None, None, None, None, None, None, None), ("q", 0, "z", None, None, None, None, None, None, "acgx", None, None, None, None, "10A")]
    write_bam(spark.createDataFrame(odd, kinds), str(tmp_path / "o"), CONTIGS, 2)
    found = {(r["contig"], r["pos"]): r for r in read_bam(spark, str(tmp_path / "o")).collect()}
    assert set(found) == {(None, -1), ("z", 5), ("z", -1)} and found["z", 5]["cigar"] == long
    assert found["z", -1]["seq"] == "ACGN" and found["z", -1]["md"] == "10A" and found[None, -1]["qname"] == "*"
    assert [r["pos"] for r in read_bam(spark, str(tmp_path / "o"), [("z", 40_004, 40_005)]).collect()] == [5]
    write_bam(spark.createDataFrame(odd[1:2], kinds), str(tmp_path / "o"), CONTIGS, 2)
    assert read_bam(spark, str(tmp_path / "o")).count() == 1
    write_bam(spark.createDataFrame(odd[1:2], kinds), str(tmp_path / "o"), CONTIGS, 2, mode="append")
    assert read_bam(spark, str(tmp_path / "o")).count() == 2
    with pytest.raises(Exception, match="nowhere"):
        write_bam(spark.createDataFrame([odd[1][:2] + ("nowhere",) + odd[1][3:]], kinds), str(tmp_path / "w"), CONTIGS)
    assert not list((tmp_path / "w").iterdir())


@pytest.mark.parametrize("longest", [5_000_000, 700_000_000])
def test_indexes_read_back_and_name_all_records(longest):
    draw, depth = random.Random(3), bam_index.depth_for(longest)
    index = bam_index.Index([bam_index.ContigIndex(), bam_index.ContigIndex()], depth, unplaced=4)
    held = []
    for n, start in enumerate(sorted(draw.randrange(longest - 70_000) for _ in range(2_000))):
        end = start + draw.choice([1, 100, 20_000, 60_000])
        span = (n * 100_000, (n + 1) * 100_000 if n % 50 else n * 100_000 + 90_000)
        index.contigs[1].add(bam_index.bin_of(start, end, depth), start, end, *span, True)
        held.append((start, end, span))
    again = bam_index.load(bam_index.dump(index))
    assert (again.depth, again.unplaced, again.contigs[0].bins) == (depth, 4, {})
    assert (again.contigs[1].bins, again.contigs[1].mapped) == (index.contigs[1].bins, 2_000)
    for _ in range(200):
        lo = draw.randrange(longest)
        hi = lo + draw.choice([1, 5_000, 200_000])
        spans = again.spans(1, [(lo, hi)])
        assert all(any(b <= s[0] and s[1] <= e for b, e in spans) for start, end, s in held if start < hi and end > lo)
    assert set(again.starts(1)) <= {s[0] for _, _, s in held}
