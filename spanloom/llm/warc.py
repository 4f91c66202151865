"""WARC archives: one gzip member for each record, written by many tasks and read back sequentially.

Payloads that occur before are written as revisits, which refer to the first record with that payload. Each writing attempt
has file names of its own, and only the files named in the manifest, which is written once for each task, count; so lost
executors and repeated attempts leave nothing twice.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import Scratch, slices

#: Bytes of an archive from which on a task begins another one.
ARCHIVE_BYTES = 256 << 20
_CHUNK = 1 << 20
_LONGEST_HEADER = 1 << 20
_VERSION = b"WARC/1.1"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@dataclass
class Record:
    """headers: names in lower case. block: what the record holds; payload: what follows its HTTP headers."""

    headers: dict[str, str]
    block: bytes

    def _split(self) -> tuple[bytes, bytes]:
        if not self.headers.get("content-type", "").startswith("application/http"):
            return b"", self.block
        head, _, payload = self.block.partition(b"\r\n\r\n")
        return head, payload

    @property
    def payload(self) -> bytes:
        return self._split()[1]

    @property
    def http(self) -> dict[str, str]:
        lines = self._split()[0].decode("utf-8", "replace").split("\r\n")[1:]
        return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def encode(kind: str, headers: dict[str, object], block: bytes, level: int = 6) -> bytes:
    """One record as a gzip member of its own."""
    lines = [_VERSION, f"WARC-Type: {kind}".encode()]
    lines += [f"{k}: {v}".encode() for k, v in headers.items() if v is not None]
    lines += [f"WARC-Block-Digest: sha1:{sha1_base32(block)}".encode(), f"Content-Length: {len(block)}".encode()]
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def read(stream: BinaryIO) -> Iterator[Record]:
    """The records of an archive in order, held one at a time.

    Each gzip member is inflated incrementally; headers, content length and the closing line ends must frame exactly one
    record in it. A record whose block or payload does not have its digest, or a cut member, raises ValueError.
    """
    rest = b""
    while True:
        rest = rest or stream.read(_CHUNK)
        if not rest:
            return
        unpack, data = zlib.decompressobj(31), bytearray()
        need = -1  # bytes of the member, once its headers are known
        headers: dict[str, str] = {}
        start = 0
        while not unpack.eof:
            if not rest:
                rest = stream.read(_CHUNK)
                if not rest:
                    raise ValueError("the archive ends inside a gzip member")
            try:
                data += unpack.decompress(rest, _CHUNK)
            except zlib.error as e:
                raise ValueError(f"no gzip member: {e}") from e
            rest = unpack.unconsumed_tail if not unpack.eof else b""
            if need < 0 and (end := data.find(b"\r\n\r\n")) >= 0:
                headers, start = _headers(bytes(data[:end])), end + 4
                need = start + int(headers["content-length"]) + 4
            if need < 0 and len(data) > _LONGEST_HEADER or 0 <= need < len(data):
                raise ValueError("a record is not framed by its headers and content length")
        rest = unpack.unused_data
        if need != len(data) or data[-4:] != b"\r\n\r\n":
            raise ValueError("a record is not framed by its headers and content length")
        record = Record(headers, bytes(data[start : need - 4]))
        _verify(record)
        yield record


def _headers(data: bytes) -> dict[str, str]:
    version, *lines = data.decode("utf-8", "replace").split("\r\n")
    if not version.startswith("WARC/1."):
        raise ValueError("no WARC record")
    found = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    if not found.get("content-length", "").isdigit():
        raise ValueError("a record has no content length")
    return found


def _verify(record: Record) -> None:
    for name, data in (("warc-block-digest", record.block), ("warc-payload-digest", record.payload)):
        stated = record.headers.get(name)
        if name == "warc-payload-digest" and record.headers.get("warc-type") == "revisit":
            continue  # the payload is that of the record referred to
        if stated and stated.startswith("sha1:") and stated[5:].upper() != sha1_base32(data):
            raise ValueError(f"{name} of {record.headers.get('warc-record-id')} does not hold")


def _roles(pages: DataFrame, tables: Scratch, page_id: str, url: str, html: str, least: int) -> DataFrame:
    """id, url, payload and refers_to (null for responses)."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).alias("id"), F.col(url).alias("url"), payload.alias("payload"))
    keyed = rows.withColumns({"sha": F.sha1("payload"), "size": F.octet_length("payload"), "mix": F.xxhash64("payload")})
    key = ["sha", "size", "mix"]
    first = keyed.where(F.col("size") >= least).groupBy(*key).agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select(*key, "first")
    first = tables.table(first, "first")
    return keyed.join(first.hint("shuffle_hash"), key, "left").select("id", "url", "payload", F.when(F.col("id").eqNullSafe(F.col("first")), None).otherwise(F.col("first")).alias("refers_to"))


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", least_revisit_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", level: int = 6, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record for each page into archives under the folder (a URI that all machines reach) and returns the manifest:
    path, records, bytes of each archive.

    A null page has an empty payload. Of pages with equal payloads of `least_revisit_bytes` or more, those with the smallest
    id are responses (more than one only where an id repeats; null ids come last and are responses only among themselves),
    the others revisits. A null url is left out. Columns other than these three are not read.
    """
    tables = Scratch(pages.sparkSession, "warc")
    rows = _roles(pages, tables, page_id, url, html, least_revisit_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out, path, records, size = None, "", 0, 0
        done: list[tuple[str, int, int]] = []
        for whole in batches:
            for batch in slices(whole, 2):
                for page in batch.to_pylist():
                    if out is None:
                        path = f"{base}/{uuid.uuid4().hex}.warc.gz"
                        out, records, size = store.open_output_stream(path, compression=None), 0, 0
                    data = _page_record(page, date, level)
                    out.write(data)
                    records, size = records + 1, size + len(data)
                    if size >= archive_bytes:
                        out.close()
                        done.append((path, records, size))
                        out = None
        if out is not None:
            out.close()
            done.append((path, records, size))
        yield pa.RecordBatch.from_arrays([pa.array([d[0].rsplit("/", 1)[1] for d in done], pa.string()), *[pa.array([d[i] for d in done], pa.int64()) for i in (1, 2)]], names=["path", "records", "bytes"])

    return tables.table(rows.mapInArrow(run, "path string, records long, bytes long"), "manifest").select(F.concat(F.lit(folder.rstrip("/") + "/"), "path").alias("path"), "records", "bytes")


def _named(page: object) -> object:
    """An id as a header's value; texts are percent-encoded."""
    return quote(page, safe="") if isinstance(page, str) else page


def _record_id(page: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"


def _page_record(page: dict, date: str, level: int) -> bytes:
    payload, first = page["payload"], page["refers_to"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = {
        "WARC-Record-ID": _record_id(page["id"]),
        "WARC-Date": date,
        "WARC-Target-URI": None if page["url"] is None else quote(page["url"], safe="%/:=&?~#+!$,;'@()*[]"),
        "Content-Type": "application/http;msgtype=response",
        "WARC-Payload-Digest": f"sha1:{sha1_base32(payload)}",
        "X-Page-ID": _named(page["id"]),
    }
    if first is None:
        return encode("response", headers, http + payload, level)
    headers |= {"WARC-Refers-To": _record_id(first), "WARC-Profile": _PROFILE, "X-Refers-To-Page-ID": _named(first)}
    return encode("revisit", headers, http, level)


def read_pages(spark: SparkSession, manifest: DataFrame, with_html: bool = False, id_type: str = "long") -> DataFrame:
    """A row for each record of the manifest's archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    For revisits size and digest are those of the payload referred to. with_html adds the payload of responses as text. A page
    without an id has a null one, and so has, as a long, one whose id is no number; id_type "string" gives ids as text. Ids
    that repeat give a row for each record, an empty manifest none.
    """
    archives = manifest.select("path")
    count = archives.count()
    html = ", html string" if with_html else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, name = pafs.FileSystem.from_uri(path)
                with store.open_input_stream(name, compression=None) as stream:
                    held, size = [], 0
                    for record in read(stream):
                        held.append(_page_row(record, with_html, id_type))
                        size += 200 + len(record.block) * with_html
                        if size > 8 << 20:
                            yield _page_batch(held, with_html, id_type)
                            held, size = [], 0
                    yield _page_batch(held, with_html, id_type)

    schema = f"page_id {id_type}, url string, payload_bytes long, payload_digest string, record_type string, refers_to {id_type}{html}"
    return archives.repartition(max(1, min(count, 100_000))).mapInArrow(run, schema)


def _page_row(record: Record, with_html: bool, id_type: str) -> tuple:
    h = record.headers

    def number(name: str) -> object:
        if id_type == "string":
            return unquote(h[name]) if name in h else None
        text = h.get(name, "")
        n = int(text) if text.removeprefix("-").isdecimal() else None
        return n if n is not None and -(1 << 63) <= n < 1 << 63 else None

    kind = h["warc-type"]
    row = (number("x-page-id"), h.get("warc-target-uri"), int(record.http["content-length"]), h["warc-payload-digest"].removeprefix("sha1:"), kind, number("x-refers-to-page-id"))
    if kind == "response" and len(record.payload) != row[2]:
        raise ValueError(f"the payload of {h.get('warc-record-id')} does not have its length")
    return (*row, record.payload.decode("utf-8") if kind == "response" else None) if with_html else row


def _page_batch(rows: list[tuple], with_html: bool, id_type: str) -> pa.RecordBatch:
    kind = pa.string() if id_type == "string" else pa.int64()
    kinds = [("page_id", kind), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", kind)]
    kinds += [("html", pa.string())] * with_html
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(kinds)], names=[n for n, _ in kinds])
