"""BAM files as a data source: read by splits or by an index, written sorted with an index.

The driver lists files and, where regions are asked for, reads headers and indexes; records are only read in tasks. Paths and URIs
are those that pyarrow's file systems reach from all machines.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from spanloom.sources import bam_index, bgzf

SCHEMA = "file string, file_ord long, qname string, flag int, contig string, pos long, mapq int, cigar string, mate_contig string, mate_pos long, isize long, seq string, qual string, mc string, mq int, nm int, md string"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
_ARROW = pa.schema([(c.split()[0], {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[c.split()[1]]) for c in SCHEMA.split(", ")])

#: Bytes of a compressed file for each partition.
SPLIT_BYTES = 64 << 20
#: Records that have to follow one another for a place to count as a record's start.
CHAIN = 8
#: Rows of a batch.
_BATCH = 2048
_END = 1 << 62
_PUSHDOWN = "spark.sql.python.filterPushdown.enabled"

_BASES, _OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
_FROM_HEX = str.maketrans("0123456789abcdef", _BASES)


class _ToHex(dict):
    """Codes of letters in either case; what is no letter of an alignment is written as N."""

    def __missing__(self, letter: int) -> str:
        at = _BASES.find(chr(letter).upper())
        self[letter] = "f" if at < 0 else f"{at:x}"
        return self[letter]


_TO_HEX = _ToHex()
_UP, _DOWN = bytes(min(i + 33, 255) for i in range(256)), bytes(max(i - 33, 0) for i in range(256))
_TAG_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
_TAG_FORMATS = {"c": "b", "C": "B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f"}

#: An interval of a contig from start up to end, which is not in it.
Region = tuple[str, int, int]


# --- records ----------------------------------------------------------------------------------------------------------


class _Content:
    """The content of blocks from one on, as far as it is needed, with the block of each place."""

    def __init__(self, stream, start: int):
        self.parts, self.data, self.marks, self.at_end = bgzf.blocks(stream, start), b"", [], False

    def more(self, place: int) -> int:
        """Reads a block more and lets go of what lies before place; returns where that is now."""
        while len(self.marks) > 1 and self.marks[1][0] <= place:
            self.marks.pop(0)
        cut = min(place, len(self.data))
        offset, part = next(self.parts, (0, None))
        if part is None:
            self.at_end = True
            return place
        self.data = self.data[cut:] + part
        self.marks = [(p - cut, o) for p, o in self.marks] + [(len(self.data) - len(part), offset)]
        return place - cut

    def offset(self, place: int) -> int:
        while len(self.marks) > 1 and self.marks[1][0] <= place:
            self.marks.pop(0)
        return self.marks[0][1] << 16 | place - self.marks[0][0]


def records(stream, begin: int) -> Iterator[tuple[int, bytes]]:
    """(virtual offset, record) from the record at a virtual offset on. ValueError for a file that ends within one."""
    held, place = _Content(stream, begin >> 16), begin & 0xFFFF
    while True:
        need = 4 if len(held.data) < place + 4 else 4 + int.from_bytes(held.data[place : place + 4], "little")
        if len(held.data) < place + need:
            place = held.more(place)
            if held.at_end:
                if place < len(held.data):
                    raise ValueError("the file ends within a record")
                return
        else:
            yield held.offset(place), held.data[place + 4 : place + need]
            place += need


def header(stream) -> tuple[list[tuple[str, int]], int]:
    """Names and lengths of the contigs, and the virtual offset of the first record."""
    held = _Content(stream, 0)

    def number(at: int) -> int:
        while len(held.data) < at + 4:
            held.more(0)
            if held.at_end:
                raise ValueError("the file has no complete header")
        return int.from_bytes(held.data[at : at + 4], "little")

    at = 8 + number(4)
    contigs, left = [], number(at)
    at += 4
    for _ in range(left):
        n = number(at)
        length = number(at + 4 + n)
        contigs.append((held.data[at + 4 : at + 3 + n].decode(), length))
        at += 8 + n
    return contigs, held.offset(at)


def _fits(data: bytes, at: int, lengths: list[int]) -> int | None:
    """Where the record that may begin here ends; 0 if none does, None if more data has to tell."""
    if len(data) < at + 36:
        return None
    size, ref, pos, n_name, _, _, n_cigar, _, n_seq, mate_ref, mate_pos = struct.unpack_from("<iiiBBHHHiii", data, at)
    for r, p in ((ref, pos), (mate_ref, mate_pos)):
        if not -1 <= r < len(lengths) or p < -1 or r >= 0 and p > lengths[r]:
            return 0
    if n_name < 1 or n_seq < 0 or size < 32 + n_name + 4 * n_cigar + (n_seq + 1) // 2 + n_seq:
        return 0
    name, ops = at + 36, at + 36 + n_name
    if len(data) < ops + 4 * n_cigar:
        return None
    if data[ops - 1] or not all(32 < c < 127 for c in data[name : ops - 1]) or any(c & 15 >= len(_OPS) for c in data[ops : ops + 4 * n_cigar : 4]):
        return 0
    return at + 4 + size


def _chained(held: _Content, place: int, lengths: list[int]) -> bool | None:
    """Whether CHAIN plausible records follow from a place, or fewer and then the file's end; None if more data has to tell."""
    end = place
    for _ in range(CHAIN):
        if held.at_end and end == len(held.data):
            return True
        after = _fits(held.data, end, lengths)
        if after is None or after > len(held.data):
            return False if held.at_end else None
        if not after:
            return False
        end = after
    return True


def first_record(stream, start: int, size: int, lengths: list[int]) -> int:
    """Virtual offset of the first record that begins in a block at or after a byte; that of the file's size if none does.

    Records carry no mark of their own, so a place counts from which a chain of plausible ones follows. The reader of the split
    before ends on the same place or raises an error, so no row is lost or doubled by a wrong guess."""
    at = bgzf.find_block(stream, start, size)
    if at >= size:
        return size << 16
    held, place = _Content(stream, at), 0
    while True:
        found = _chained(held, place, lengths)
        if found:
            return size << 16 if place == len(held.data) else held.offset(place)
        place = held.more(place) if found is None else place + 1


def _tags(data: bytes) -> dict[str, object]:
    out, at = {}, 0
    while at + 3 <= len(data):
        name, kind = data[at : at + 2].decode("latin-1"), chr(data[at + 2])
        at += 3
        if kind in "ZH":
            end = data.index(b"\0", at)
            out[name], at = data[at:end].decode("latin-1"), end + 1
        elif kind == "B":
            n, part = int.from_bytes(data[at + 1 : at + 5], "little"), chr(data[at])
            if name == "CG":
                out[name] = struct.unpack_from(f"<{n}I", data, at + 5)
            at += 5 + _TAG_SIZES[part] * n
        else:
            out[name] = chr(data[at]) if kind == "A" else struct.unpack_from(_TAG_FORMATS[kind], data, at)[0]
            at += _TAG_SIZES[kind]
    return out


@lru_cache(1 << 14)
def _covered(ops: tuple[int, ...]) -> int:
    """Letters of the reference under an alignment; at least 1, as for a read that is only placed."""
    return max(1, sum(x >> 4 for x in ops if _OPS[x & 15] in "MDN=X"))


def _record(data: bytes, names: list[str]) -> tuple:
    ref, pos, n_name, mapq, _, n_cigar, flag, n_seq, mate_ref, mate_pos, isize = struct.unpack_from("<iiBBHHHiiii", data, 0)
    at = 32 + n_name
    qname = data[32 : at - 1].decode("latin-1")
    ops = struct.unpack_from(f"<{n_cigar}I", data, at)
    at += 4 * n_cigar
    packed = data[at : at + (n_seq + 1) // 2]
    at += len(packed)
    qual = data[at : at + n_seq]
    tags = _tags(data[at + n_seq :])
    if "CG" in tags and len(ops) == 2 and ops[0] == n_seq << 4 | 4:  # more operations than fit: they are in a tag
        ops = tags["CG"]
    cigar = "".join(f"{x >> 4}{_OPS[x & 15]}" for x in ops)
    name = lambda i: names[i] if i >= 0 else None
    text = None if not n_seq or qual[0] == 255 else qual.translate(_UP).decode("latin-1")
    return (qname, flag, name(ref), pos, mapq, cigar or None, name(mate_ref), mate_pos, isize, packed.hex().translate(_FROM_HEX)[:n_seq] or None, text, tags.get("MC"), tags.get("MQ"), tags.get("NM"), tags.get("MD"))


# --- reading ----------------------------------------------------------------------------------------------------------


class _Regions:
    """Intervals by contig, those of one contig without overlaps."""

    def __init__(self, regions: list[Region]):
        self.by: dict[str, list[tuple[int, int]]] = {}
        for contig in {r[0] for r in regions}:
            self.by[contig] = bam_index.merged([(max(s, 0), _END if e is None else e) for c, s, e in regions if c == contig and (e is None or e > max(s, 0))])

    def hold(self, contig: str, start: int, end: int) -> bool:
        """Whether [start, end) overlaps one of them."""
        of = self.by.get(contig, ())
        i = bisect_left(of, (end,)) - 1
        return i >= 0 and of[i][1] > start


@dataclass
class _Part(InputPartition):
    """Records from a virtual offset up to another, or those that begin in the blocks of a split."""

    path: str
    begin: int
    end: int
    split: bool
    size: int


class BamDataSource(DataSource):
    """spark.read.format("bam").load(path): a file, or the .bam files of a folder; columns as in SCHEMA. Options:

    splitBytes (at least 65,536): bytes of a partition. regions: JSON list of [contig, start, end], 0-based, end excluded or null for
    all from start on; reads that overlap one or more of them are returned once, by the index where a file has one (.bai or .csi).
    pushdown: `true` lets filters on contig and pos choose what is read too; it needs the session setting that read_bam() makes.

    file_ord is the record's virtual offset, so it orders a file's records whatever the splits.

    df.write.format("bam").option("contigs", json).save(path): see write_bam(), which sorts as this needs."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BamReader:
        return (_PushingReader if self.options.get("pushdown") == "true" else BamReader)(self.options)

    def writer(self, schema, overwrite: bool) -> BamWriter:
        return BamWriter(self.options, overwrite)


class BamReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.size = max(int(options.get("splitBytes", SPLIT_BYTES)), bgzf.MOST)
        self.regions = _Regions(json.loads(options["regions"])) if "regions" in options else None
        self.pushed: _Regions | None = None

    def partitions(self) -> list[_Part]:
        store, base = _store(self.path)
        info = store.get_file_info(base)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        folder = info.path if info.type == pafs.FileType.Directory else info.path.rpartition("/")[0]
        sizes = {i.path: i.size for i in store.get_file_info(pafs.FileSelector(folder)) if not i.base_name.startswith(("_", "."))}
        found = [info.path] if info.type == pafs.FileType.File else sorted(p for p in sizes if p.endswith(".bam"))
        wanted, out = self.regions or self.pushed, []
        for path in found:
            size = sizes.get(path, info.size)
            index = next((p for p in (f"{path}.bai", f"{path}.csi", path.removesuffix(".bam") + ".bai") if p in sizes), None)
            if wanted is None or index is None:
                out += [_Part(path, at, min(at + self.size, size), True, size) for at in range(0, size, self.size)]
            else:
                out += [_Part(path, b, e, False, size) for b, e in self._spans(store, path, index, wanted)]
        return out

    def _spans(self, store, path: str, index: str, wanted: _Regions) -> list[tuple[int, int]]:
        """What the index names for the regions, cut where records begin, to about the size of a split."""
        with store.open_input_stream(index, compression=None) as stream:
            held = bam_index.load(stream.read())
        with store.open_input_file(path) as stream:
            contigs, _ = header(stream)
        out = []
        for ref, (name, _) in enumerate(contigs):
            if name not in wanted.by or ref >= len(held.contigs):
                continue
            starts = held.starts(ref)
            for begin, end in held.spans(ref, wanted.by[name]):
                for cut in starts[bisect_left(starts, begin + 1) :]:
                    if cut >= end:
                        break
                    if (cut >> 16) - (begin >> 16) >= self.size:
                        out.append((begin, cut))
                        begin = cut
                out.append((begin, end))
        return out

    def read(self, part: _Part | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # what Spark hands over where there are no partitions
            return
        store, _ = _store(self.path)
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)
        with store.open_input_file(part.path) as stream, store.open_input_file(part.path) as other:
            contigs, first = header(other)
            names, lengths = [c for c, _ in contigs], [n for _, n in contigs]
            begin = part.begin if not part.split else first if part.begin == 0 else first_record(other, part.begin, part.size, lengths)
            stop = part.end << 16 if part.split else part.end
            rows, landed = [], begin
            if begin < stop:
                landed = part.size << 16
                for at, data in records(stream, begin):
                    if at >= stop:
                        landed = at
                        break
                    if self._wanted(data, names):
                        rows.append((part.path, at, *_record(data, names)))
                        if len(rows) == _BATCH:
                            yield batch(rows)
                            rows = []
            if part.split and part.end < part.size and first_record(other, part.end, part.size, lengths) != landed:
                raise ValueError(f"{part.path}: the record after byte {part.end} cannot be told from other data; choose other splitBytes")
            if rows:
                yield batch(rows)

    def _wanted(self, data: bytes, names: list[str]) -> bool:
        asked = [r for r in (self.regions, self.pushed) if r is not None]
        if not asked:
            return True
        ref, pos, n_name, _, _, n_cigar = struct.unpack_from("<iiBBHH", data, 0)
        if ref < 0:
            return False
        end = pos + _covered(struct.unpack_from(f"<{n_cigar}I", data, 32 + n_name))
        return all(r.hold(names[ref], pos, end) for r in asked)


class _PushingReader(BamReader):
    """Filters on contig and pos say what is read; Spark applies them again, so a wider choice does no harm."""

    def pushFilters(self, filters: list[Filter]) -> list[Filter]:
        contigs: set[str] | None = None
        low, high = 0, _END
        for f in filters:
            value = getattr(f, "value", None)
            if isinstance(f, In) and f.attribute == ("contig",) or isinstance(f, EqualTo | EqualNullSafe) and f.attribute == ("contig",) and value is not None:
                named = set(f.value) if isinstance(f, In) else {value}
                contigs = named if contigs is None else contigs & named
            elif getattr(f, "attribute", None) == ("pos",) and value is not None:
                if isinstance(f, EqualTo | EqualNullSafe | GreaterThanOrEqual | GreaterThan):
                    low = max(low, value + isinstance(f, GreaterThan))
                if isinstance(f, EqualTo | EqualNullSafe | LessThanOrEqual | LessThan):
                    high = min(high, value + (not isinstance(f, LessThan)))
        if contigs is not None:
            self.pushed = _Regions([(c, low, high) for c in contigs if c is not None])
        return filters


# --- writing ----------------------------------------------------------------------------------------------------------


@lru_cache(1 << 14)
def _ops(cigar: str | None) -> tuple[int, ...]:
    out, n = [], 0
    for c in cigar or "":
        if c.isdigit():
            n = 10 * n + int(c)
        else:
            out.append(n << 4 | _OPS.index(c))
            n = 0
    return tuple(out)


def _encoded(row: dict, refs: dict[str, int], depth: int) -> tuple[int, int, int, int, bytes]:
    """Contig's number (-1 for none), start, end, bin and the record's bytes."""
    ref, mate = (refs[c] if c is not None else -1 for c in (row["contig"], row["mate_contig"]))
    number = lambda name, none: none if row[name] is None else row[name]
    pos = number("pos", -1)
    seq, qname, ops = row["seq"] or "", (row["qname"] or "*").encode("latin-1"), _ops(row["cigar"])
    if not 0 < len(qname) < 255:
        raise ValueError(f"a read's name has 1 to 254 letters, not {len(qname)}")
    covered, tags = _covered(ops), b""
    if len(ops) > 0xFFFF:
        tags = b"CGBI" + struct.pack(f"<I{len(ops)}I", len(ops), *ops)
        ops = (len(seq) << 4 | 4, covered << 4 | 3)
    for name, tag in (("mc", b"MCZ"), ("md", b"MDZ")):
        if row[name] is not None:
            tags += tag + row[name].encode("latin-1") + b"\0"
    for name, tag in (("mq", b"MQi"), ("nm", b"NMi")):
        if row[name] is not None:
            tags += tag + struct.pack("<i", row[name])
    start = max(pos, 0)
    bin_ = bam_index.bin_of(start, start + covered, depth)
    code = seq.translate(_TO_HEX)
    packed = bytes.fromhex(code + "0" * (len(code) % 2))
    qual = b"\xff" * len(seq) if row["qual"] is None else row["qual"].encode("latin-1").translate(_DOWN)
    if len(qual) != len(seq):
        raise ValueError(f"{row['qname']}: {len(qual)} qualities for {len(seq)} letters")
    fields = struct.pack("<iiBBHHHiiii", ref, pos, len(qname) + 1, number("mapq", 0), bam_index.bin_of(start, start + covered) & 0xFFFF, len(ops), number("flag", 0), len(seq), mate, number("mate_pos", -1), number("isize", 0))
    body = fields + qname + b"\0" + struct.pack(f"<{len(ops)}I", *ops) + packed + qual + tags
    return ref, start, start + covered, bin_, struct.pack("<i", len(body)) + body


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


class BamWriter(DataSourceArrowWriter):
    """A task's rows, sorted by contig (in the order of `contigs`, none last) and pos, as a file with its index. Files lie in a
    folder of their own until the job commits, so attempts that failed leave nothing."""

    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite, self.run = options["path"].rstrip("/"), overwrite, uuid.uuid4().hex[:8]
        self.contigs = [(c, int(n)) for c, n in json.loads(options["contigs"])]

    def _head(self) -> bytes:
        text = "@HD\tVN:1.6\tSO:coordinate\n" + "".join(f"@SQ\tSN:{c}\tLN:{n}\n" for c, n in self.contigs)
        out = b"BAM\1" + struct.pack("<i", len(text.encode())) + text.encode() + struct.pack("<i", len(self.contigs))
        return out + b"".join(struct.pack("<i", len(c.encode()) + 1) + c.encode() + b"\0" + struct.pack("<i", n) for c, n in self.contigs)

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        store, base = _store(self.path)
        task = TaskContext.get().partitionId()
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None and task:
            return _Written([])
        name = f"part-{task:05d}-{self.run}-{uuid.uuid4().hex[:8]}.bam"
        folder = f"{base}/_temporary-{self.run}"
        store.create_dir(folder, recursive=True)
        refs = {c: i for i, (c, _) in enumerate(self.contigs)}
        depth = bam_index.depth_for(max((n for _, n in self.contigs), default=0))
        index = bam_index.Index([bam_index.ContigIndex() for _ in self.contigs], depth)
        with store.open_output_stream(f"{folder}/{name}", compression=None) as out:
            sink = bgzf.Writer(out)
            sink.write(self._head())
            last = (0, -1)
            for batch in () if first is None else self._all(first, batches):
                columns = [batch.column(c).to_pylist() if c in batch.schema.names else [None] * batch.num_rows for c in COLUMNS]
                for values in zip(*columns, strict=True):
                    row = dict(zip(COLUMNS, values, strict=True))
                    ref, start, end, bin_, data = _encoded(row, refs, depth)
                    place = (ref if ref >= 0 else len(refs), start)
                    if place < last:
                        raise ValueError("rows are not sorted by contig and pos")
                    last, begins = place, sink.tell()
                    sink.write(data)
                    if ref < 0:
                        index.unplaced += 1
                    else:
                        index.contigs[ref].add(bin_, start, end, begins, sink.tell(), not (row["flag"] or 0) & 4)
            sink.close()
        suffix = "bai" if depth == bam_index.DEPTH else "csi"
        with store.open_output_stream(f"{folder}/{name}.{suffix}", compression=None) as out:
            out.write(bam_index.dump(index))
        return _Written([name, f"{name}.{suffix}"])

    @staticmethod
    def _all(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield first
        yield from rest

    def commit(self, messages: list[_Written | None]) -> None:
        store, base = _store(self.path)
        old = [i.path for i in store.get_file_info(pafs.FileSelector(base, allow_not_found=True)) if i.base_name.startswith("part-")]
        for name in (n for m in messages if m for n in m.names):
            store.move(f"{base}/_temporary-{self.run}/{name}", f"{base}/{name}")
        if self.overwrite:
            for path in old:
                store.delete_file(path)
        self._clear(store, base)

    def abort(self, messages: list[_Written | None]) -> None:
        self._clear(*_store(self.path))

    def _clear(self, store, base: str) -> None:
        if store.get_file_info(f"{base}/_temporary-{self.run}").type != pafs.FileType.NotFound:
            store.delete_dir(f"{base}/_temporary-{self.run}")


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), os.path.abspath(path.removeprefix("file:"))


def _registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(BamDataSource)
    return spark


def read_bam(spark: SparkSession, path: str, regions: list[Region] | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records of a BAM file or of a folder's. With regions only those that overlap one of them, each once. Filters on contig and
    pos are pushed down; the session's setting for that in Python data sources is switched on."""
    spark.conf.set(_PUSHDOWN, "true")
    found = _registered(spark).read.format("bam").option("splitBytes", split_bytes).option("pushdown", "true")
    return (found if regions is None else found.option("regions", json.dumps(regions))).load(path)


def write_bam(reads: DataFrame, path: str, contigs: list[tuple[str, int]], parts: int | None = None, mode: str = "overwrite") -> None:
    """A folder of BAM files, each with header and index, which in order of their names are sorted by contig (in the order
    given, with its length; none last) and pos. Parts are cut by range, also within a position with very many reads.

    reads: columns of SCHEMA, of which missing ones are null and others are left out. A contig that is not given is an error, as are
    qualities whose number is not that of the letters."""
    spark = _registered(reads.sparkSession)
    kinds = [c.split() for c in SCHEMA.split(", ")]
    rows = reads.select(*[(F.col(f"`{c}`") if c in reads.columns else F.lit(None)).cast(kind).alias(c) for c, kind in kinds])
    order = spark.createDataFrame([(c, i) for i, (c, _) in enumerate(contigs)], "contig string, ord int")
    ranked = rows.join(F.broadcast(order), "contig", "left").withColumn("ord", F.coalesce("ord", F.lit(len(contigs))))  # a row for each contig
    # a third of all reads may lie at one place: their names and flags cut it too
    keys = ["ord", F.coalesce("pos", F.lit(-1)), "qname", "flag"]
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = ranked.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select(*COLUMNS)
    dealt.write.format("bam").mode("overwrite" if mode == "overwrite" else "append").option("contigs", json.dumps(contigs)).save(path)
