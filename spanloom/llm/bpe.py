"""Byte-level BPE encoding and decoding through a table of distinct words.

Texts are cut into words as the tokenizer does; each distinct word is encoded once. The codes of frequent words, a table
of bounded size, go to every task; rarer words are sent with their positions to the table and joined there, and their ids
come back to their places. Decoding joins ids with the vocabulary's pieces, a table of fixed size that every task holds.
A task handles words, ids and pieces as columns: a text's words are a view of its bytes, and joins are takes of positions.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import KeyFilter, Scratch, slices, text_key

#: At most so many words, of at most so many characters each, are sent to every task.
HOT_WORDS, HOT_LENGTH = 1 << 18, 48
#: Bytes of text whose words a task counts before it sends them on, whose ids it makes at a time, and which it cuts at a time.
_COUNTED_BYTES, _CODED_BYTES, _CUT_BYTES = 4 << 20, 2 << 20, 1 << 19
#: The pre-tokenizer whose rule `Splitter` follows. Files with another one are cut by the library.
_RULE = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
_SPACE, _LETTER, _NUMBER, _OTHER, _UNKNOWN = range(5)


class Splitter:
    """Cuts texts into words as the tokenizer's own pre-tokenizer does, many texts at once.

    The rule: contractions ('s 't 'm 'd 're 've 'll); runs of letters, of numbers or of other characters, each with one blank
    before it; runs of white space, without the last character where another word follows. What is a letter, a number or white
    space is asked of the library, once for each character that occurs.
    """

    def __init__(self, tokenizer, rule: dict, special: list[str]):
        self._library = tokenizer.pre_tokenizer.pre_tokenize_str
        self._by_rule = rule is not None and all(rule.get(k) == v for k, v in _RULE.items())
        self._special = special
        self._pattern = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self._kinds = np.full(0x110000, _UNKNOWN, dtype=np.uint8)

    def split(self, texts: pa.Array) -> tuple[pa.LargeStringArray, np.ndarray]:
        """The words of all texts (nulls have none), and the index of each text's first word, with the number of words at the end."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        offsets, base = offsets - offsets[0], int(offsets[0])
        size = int(offsets[-1])
        data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[base : base + size] if size else np.zeros(0, np.uint8)
        heads = np.unique(offsets[offsets < size])
        found, at = [], 0
        while at < size:
            end = _piece_end(data, heads, at)
            if self._by_rule:
                found.append(at + self._starts(data[at:end], heads[slice(*np.searchsorted(heads, [at, end]))] - at))
            at = end
        starts = np.concatenate([np.zeros(0, np.int64), *found])
        starts = self._by_library(texts, offsets, starts)
        ends = np.append(starts, size)
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(data))
        return words, np.searchsorted(ends, offsets)

    def _by_library(self, texts: pa.Array, offsets: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The starts with those of texts that the library cuts: texts with special tokens, which are words, or all under another rule."""
        chosen = np.full(len(texts), not self._by_rule)
        for token in self._special:
            chosen |= np.asarray(pc.match_substring(texts, token))
        rows = np.flatnonzero(chosen & (offsets[1:] > offsets[:-1]))
        if not len(rows):
            return starts
        keep, more = np.ones(len(starts), dtype=bool), []
        for row in rows.tolist():
            keep[slice(*np.searchsorted(starts, offsets[row : row + 2]))] = False
            sizes = [len(w.encode()) for w in self._words(texts[row].as_py())]
            if sum(sizes) != offsets[row + 1] - offsets[row]:
                raise ValueError("the tokenizer's words do not cover the text; only byte-level tokenizers without a normaliser are supported")
            more.append(offsets[row] + np.cumsum([0, *sizes[:-1]]))
        return np.sort(np.concatenate([starts[keep], *more]))

    def _words(self, text: str) -> list[str]:
        out, at = [], 0
        for a, b in [m.span() for m in self._pattern.finditer(text)] if self._pattern else []:
            out += [*self._plain(text[at:a]), text[a:b]]
            at = b
        return out + self._plain(text[at:])

    def _plain(self, text: str) -> list[str]:
        return [text[a:b] for _, (a, b) in self._library(text)] if text else []

    def _learn(self, points: np.ndarray) -> None:
        for c in np.unique(points).tolist():
            alone = [len(self._library(x + chr(c))) == 1 for x in "a1!"]
            self._kinds[c] = (_LETTER, _NUMBER, _OTHER)[alone.index(True)] if any(alone) else _SPACE

    def _starts(self, data: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """Byte offsets of the words of `data`, which begins with one; texts begin at `heads`."""
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype="<u4")
        n = len(points)
        lead = None if n == len(data) else np.flatnonzero((data & 0xC0) != 0x80)
        kinds = self._kinds[points]
        if (unknown := kinds == _UNKNOWN).any():
            self._learn(points[unknown])
            kinds = self._kinds[points]
        first = np.zeros(n + 1, dtype=bool)
        first[heads if lead is None else np.searchsorted(lead, heads)] = True
        first[[0, n]] = True
        space = kinds == _SPACE
        start = first[:n].copy()
        start[1:] |= np.where(space[1:], ~space[:-1], (kinds[1:] != kinds[:-1]) & (points[:-1] != 32))
        start[:-1] |= space[:-1] & ~space[1:] & ~first[1:n]  # the last white space before a word
        marks = np.flatnonzero(start & (points == 39))
        marks = marks[~first[marks + 1]]
        after = points[marks + 1]
        short = marks[np.isin(after, [ord(c) for c in "stmd"])]
        longer = marks[np.isin(after, [ord(c) for c in "rvl"])]
        longer = longer[~first[longer + 2]]
        longer = longer[points[longer + 2] == np.where(points[longer + 1] == ord("l"), ord("l"), ord("e"))]
        start[short + 1] = start[longer + 1] = False
        ends = np.concatenate([short + 2, longer + 3])
        start[ends[ends < n]] = True
        found = np.flatnonzero(start)
        return found if lead is None else lead[found]


def _piece_end(data: np.ndarray, heads: np.ndarray, at: int) -> int:
    """Where the next piece of some _CUT_BYTES ends: before a text, or inside of a long one at white space after a printable ASCII
    character, where a word begins under every reading; a text without such a place is one piece."""
    target = at + _CUT_BYTES
    if target >= len(data):
        return len(data)
    k = int(np.searchsorted(heads, target, "right")) - 1
    if heads[k] > at:
        return int(heads[k])
    stop, width = int(heads[k + 1]) if k + 1 < len(heads) else len(data), 1 << 16
    while target < stop:
        seen = data[target - 1 : min(target + width, stop)]
        white = (seen[1:] == 32) | ((seen[1:] >= 9) & (seen[1:] <= 13))
        places = np.flatnonzero(white & (seen[:-1] > 32) & (seen[:-1] < 127))
        if len(places):
            return target + int(places[0])
        target, width = target + width, width * 4
    return stop


class Vocabulary:
    """A byte-level tokenizer file: its splitting, its pieces and its encoder."""

    def __init__(self, source: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(source)
        spec = json.loads(source)
        if spec.get("normalizer") or (spec.get("decoder") or {}).get("type") != "ByteLevel":
            raise ValueError("only byte-level tokenizers without a normaliser are supported")
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.splitter = Splitter(self.tokenizer, spec["pre_tokenizer"], list(special))
        direct = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
        other = [b for b in range(256) if b not in set(direct)]
        byte = {chr(b): b for b in direct} | {chr(256 + i): b for i, b in enumerate(other)}
        pieces = [b""] * (1 + max([*spec["model"]["vocab"].values(), *special.values()]))
        for piece, i in (spec["model"]["vocab"] | special).items():
            pieces[i] = bytes(byte[c] for c in piece) if all(c in byte for c in piece) else piece.encode()
        self.pieces = pa.array(pieces, pa.large_binary())

    def encode(self, words: list[str]) -> list[bytes]:
        """Each word's ids as little-endian 32-bit numbers."""
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def decode(self, ids: pa.Array) -> list[bytes | None]:
        """The texts, in UTF-8, of a column of ids (little-endian 32-bit numbers): each id is joined with its piece."""
        ids, present = ids.cast(pa.large_binary()), np.asarray(ids.is_valid())
        filled = pc.fill_null(ids, b"")
        offsets, data = _buffers(filled)
        joined = self.pieces.take(pa.array(np.frombuffer(data, dtype="<u4")))
        ends, text = _buffers(joined)
        at = ends[offsets // 4].tolist()
        return [_whole(text[a:b]) if p else None for a, b, p in zip(at, at[1:], present.tolist(), strict=False)]


def _buffers(column: pa.LargeBinaryArray) -> tuple[np.ndarray, memoryview]:
    """Offsets from zero and the bytes between the first and the last."""
    if not len(column):
        return np.zeros(1, np.int64), memoryview(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = memoryview(column.buffers()[2] or b"")[int(offsets[0]) : int(offsets[-1])]
    return offsets - offsets[0], data


def _whole(text: memoryview) -> bytes:
    """The bytes where they are valid UTF-8; else with U+FFFD for what is not."""
    raw = bytes(text)
    try:
        raw.decode()
    except UnicodeDecodeError:
        return raw.decode("utf-8", "replace").encode()
    return raw


_CACHE: dict[int, Vocabulary] = {}


def _vocabulary(source: Broadcast) -> Vocabulary:
    """One for each worker process."""
    key = hash(source.value)
    if key not in _CACHE:
        _CACHE[key] = Vocabulary(source.value)
    return _CACHE[key]


class _Words:
    """The words of a slice of texts as positions in the table of its distinct words, and those words' codes, null where unknown."""

    def __init__(self, vocabulary: Vocabulary, texts: pa.Array, known: tuple[pa.Array, pa.Array] | None = None):
        self.words, self.first = vocabulary.splitter.split(texts)
        table = self.words.dictionary_encode()
        self.at, self.distinct = np.array(table.indices, dtype=np.int64), table.dictionary
        if known is not None:
            self.codes = known[1].take(pc.index_in(self.distinct, value_set=known[0]))

    def places(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and place within the row of words."""
        row = np.searchsorted(self.first, words, "right") - 1
        return row, words - self.first[row]

    def ids(self) -> pa.LargeBinaryArray:
        """A row's codes joined together; unknown words have none."""
        ends, data = _buffers(self.codes.take(pa.array(self.at)))
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.first) - 1, [None, pa.py_buffer(ends[self.first]), pa.py_buffer(data)])


def word_table(docs: DataFrame, source: Broadcast) -> DataFrame:
    """docs: t, id, tk. word, n and codes: each distinct word of the texts, how often it occurs, and its ids; and id, tk and pos,
    the place of a word that occurs once (for others they mean nothing)."""
    id_type = docs.schema["id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(source)
        for whole in batches:
            for batch in slices(whole, 0, _COUNTED_BYTES):
                words = _Words(vocabulary, batch.column(0))
                n, last = np.bincount(words.at, minlength=len(words.distinct)), np.zeros(len(words.distinct), dtype=np.int64)
                last[words.at] = np.arange(len(words.at))
                row, pos = words.places(last)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([words.distinct.cast(pa.string()), pa.array(n, pa.int64()), batch.column(1).take(at), batch.column(2).take(at), pa.array(pos.astype(np.int32))], names=["word", "n", "id", "tk", "pos"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(source)
        for batch in batches:
            codes = pa.array(vocabulary.encode(batch.column(0).to_pylist()), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, codes], names=[*batch.schema.names, "codes"])

    schema = f"word string, n long, id {id_type}, tk long, pos int"
    words = docs.where(F.length("t") > 0).select("t", "id", "tk").mapInArrow(count, schema).groupBy("word")
    return words.agg(F.sum("n").alias("n"), F.max("id").alias("id"), F.max("tk").alias("tk"), F.max("pos").alias("pos")).mapInArrow(encode, f"{schema}, codes binary")


def _hot(table: DataFrame, most: int) -> Column:
    """Which words are hot: all short ones from the least frequency class on with which they are not more than `most`."""
    rank, short = F.floor(F.log2("n") * 4).cast("int"), F.length("word") <= HOT_LENGTH
    sizes = {r["rank"]: r["c"] for r in table.where(short).groupBy(rank.alias("rank")).agg(F.count("*").alias("c")).collect()}  # a few hundred rows at most
    total, least = 0, None
    for r in sorted(sizes, reverse=True):
        total += sizes[r]
        if total > most:
            break
        least = r
    return F.lit(False) if least is None else short & (rank >= least)


def _pack_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, array<struct<pos, codes>>, as compressed numbers: how many, the places, the codes' sizes, the codes."""
    squeeze = zstandard.ZstdCompressor().compress
    for batch in batches:
        bounds = np.asarray(batch.column(2).offsets, dtype=np.int64)
        places, codes = batch.column(2).flatten().flatten()
        places, (ends, data) = np.asarray(places).astype("<u4"), _buffers(codes.cast(pa.large_binary()))
        sizes, bounds = np.diff(ends).astype("<u4"), bounds - bounds[0]
        out = [squeeze(b"".join([np.uint32(b - a).tobytes(), places[a:b].tobytes(), sizes[a:b].tobytes(), data[ends[a] : ends[b]]])) for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["id", "tk", "rare"])


def _unpack_places(data: bytes) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Places, sizes of their codes, and all codes."""
    n = int.from_bytes(data[:4], "little")
    heads = np.frombuffer(data, dtype="<u4", count=1 + 2 * n)[1:]
    return heads[:n], heads[n:], data[4 + 8 * n :]


_RESULT = [("n_tokens", pa.int64(), "long"), ("ids_sha256", pa.string(), "string"), ("decoded_sha256", pa.string(), "string"), ("ids", pa.binary(), "binary"), ("decoded", pa.string(), "string")]
_RESULT_NAMES, _RESULT_SCHEMA = [n for n, _, _ in _RESULT], ", ".join(f"{n} {t}" for n, _, t in _RESULT)


def _results(vocabulary: Vocabulary, ids: pa.Array, with_ids: bool) -> list[pa.Array]:
    """The columns of _RESULT for a column of ids; nulls for nulls, ids and decoded only where asked for."""
    texts = vocabulary.decode(ids)
    digests = [None if i is None else hashlib.sha256(i).hexdigest() for i in ids.to_pylist()]
    decoded = [None if t is None else hashlib.sha256(t).hexdigest() for t in texts]
    counts = pc.divide(pc.binary_length(ids), 4).cast(pa.int64())
    if not with_ids:
        ids, texts = pa.nulls(len(ids), pa.binary()), [None] * len(ids)
    return [counts, pa.array(digests, pa.string()), pa.array(decoded, pa.string()), ids.cast(pa.binary()), pa.array(texts, pa.binary()).cast(pa.string())]


def decode(df: DataFrame, tokenizer_json: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the text of each row's ids (binary, little-endian 32-bit numbers) in the column `out`: ids joined with their pieces,
    a table of the vocabulary's size that every task holds. Bytes that are not UTF-8 become U+FFFD; null stays null."""
    source = df.sparkSession.sparkContext.broadcast(tokenizer_json)
    rows = df.select(F.col(ids).alias("i"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    kind = rows.schema["row"].dataType.simpleString()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(source)
        for whole in batches:
            for batch in slices(whole, 0, _CODED_BYTES):
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(vocabulary.decode(batch.column(0)), pa.binary()).cast(pa.string())], names=["row", "found"])

    return rows.mapInArrow(join, f"row {kind}, found string").select("row.*", F.col("found").alias(out))


def encode_decode(docs: DataFrame, tokenizer_json: str, text: str = "text", id_col: str = "doc_id", keep: list[str] | None = None, hot_words: int = HOT_WORDS, with_ids: bool = False) -> DataFrame:
    """The columns `keep` with n_tokens, ids_sha256 and decoded_sha256; with_ids adds ids (little-endian 32-bit numbers, binary) and decoded.

    tokenizer_json: the content of a tokenizer file, byte-level and without a normaliser (others raise ValueError). A null text
    counts as empty. Rows that agree on id and text count as one document and get the same result. Columns other than `keep`,
    the id and the text are not read.
    """
    keep = docs.columns if keep is None else keep
    Vocabulary(tokenizer_json)  # raises for files that are not supported
    spark, tables = docs.sparkSession, Scratch(docs.sparkSession, "bpe", thorough=True)
    source = spark.sparkContext.broadcast(tokenizer_json)
    rows = docs.select(F.col(text).alias("t"), F.col(id_col).alias("id"), text_key(text).alias("tk"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"))
    table = tables.table(word_table(rows, source), "words")
    is_hot = _hot(table, hot_words)
    found = table.where(is_hot).select("word", "codes").toArrow().combine_chunks()
    hot = spark.sparkContext.broadcast((_column(found.column(0), pa.large_string()), _column(found.column(1), pa.large_binary())))
    once = table.where(~is_hot & (F.col("n") == 1)).select("id", "tk", "pos", "codes")
    again = table.where(~is_hot & (F.col("n") > 1)).select("word", "codes", F.xxhash64("word").alias("h"))
    repeats = spark.sparkContext.broadcast(KeyFilter.build(again, "h", 21))
    row_type, id_type = rows.schema["row"].dataType.simpleString(), rows.schema["id"].dataType.simpleString()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, repeated = _vocabulary(source), repeats.value
        for whole in batches:
            for batch in slices(whole, 0, _CODED_BYTES):
                words = _Words(vocabulary, batch.column(0), hot.value)
                unknown = np.asarray(words.codes.is_null())
                sent = np.flatnonzero(unknown)
                hashes = [xxhash.xxh64_intdigest(w, 42) for w in words.distinct.take(pa.array(sent)).cast(pa.large_binary()).to_pylist()]
                joined = np.zeros(len(unknown), dtype=bool)
                joined[sent] = repeated.has(np.array(hashes, dtype=np.uint64).view(np.int64))
                missing = np.concatenate([[0], np.cumsum(unknown[words.at])])[words.first]
                whole_rows = missing[1:] == missing[:-1]
                at = np.flatnonzero(joined[words.at])
                _, pos = words.places(at)
                entries = pa.StructArray.from_arrays([pa.array(pos.astype(np.int32)), words.words.take(pa.array(at)).cast(pa.string())], ["pos", "word"])
                rare = pa.ListArray.from_arrays(pa.array(np.searchsorted(at, words.first).astype(np.int32)), entries, mask=pa.array(whole_rows))
                ids = pc.if_else(pa.array(whole_rows), words.ids(), pa.scalar(None, pa.large_binary()))
                yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), batch.column(3), *_results(vocabulary, ids, with_ids), rare], names=["id", "tk", "row", *_RESULT_NAMES, "rare"])

    done = tables.table(rows.mapInArrow(first, f"id {id_type}, tk long, row {row_type}, {_RESULT_SCHEMA}, rare array<struct<pos:int,word:string>>"), "done")
    places = done.where("rare is not null").select("id", "tk", F.explode("rare").alias("r")).select("id", "tk", "r.pos", "r.word")
    # a word that occurs once has its place in the table; dealt by document first, as a partial collection would only make rows larger
    found = places.join(again.drop("h"), "word").select("id", "tk", "pos", "codes").unionByName(once)
    found = found.repartition("id", "tk")
    back = found.groupBy("id", "tk").agg(F.collect_set(F.struct("pos", "codes")).alias("rare"))
    back = tables.table(back.mapInArrow(_pack_places, f"id {id_type}, tk long, rare binary").withColumnsRenamed({"id": "rid", "tk": "rtk"}), "back")
    del places, found
    late_keys = spark.sparkContext.broadcast(KeyFilter.build(back.select(F.xxhash64("rid", "rtk").alias("h")), "h", 21))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows that may have rare words, their texts compressed for the shuffle."""
        squeeze = zstandard.ZstdCompressor(level=6).compress
        for whole in batches:
            for batch in slices(whole.filter(pa.array(late_keys.value.has(np.asarray(whole.column(4))))), 0, _CODED_BYTES):
                texts = [squeeze(t or b"") for t in batch.column(0).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), *[batch.column(i) for i in (1, 2, 3)]], names=["t", "id", "tk", "row"])

    tables.drop("words")
    rest = rows.withColumn("h", F.xxhash64("id", "tk")).mapInArrow(pack, f"t binary, id {id_type}, tk long, row {row_type}")
    rest = rest.join(back.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("rid")) & F.col("tk").eqNullSafe(F.col("rtk")))

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, expand = _vocabulary(source), zstandard.ZstdDecompressor().decompress
        for whole in batches:
            for batch in slices(whole, 0, 1 << 20):
                words = _Words(vocabulary, pa.array([expand(t) for t in batch.column(0).to_pylist()], pa.large_binary()).cast(pa.large_string()), hot.value)
                found = [_unpack_places(expand(r)) for r in batch.column(1).to_pylist()]
                at = np.concatenate([words.first[i] + pos for i, (pos, _, _) in enumerate(found)])
                words.at[at] = len(words.codes) + np.arange(len(at))
                ends = np.concatenate([[0], np.cumsum(np.concatenate([sizes for _, sizes, _ in found]), dtype=np.int64)])
                codes = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(b"".join([c for _, _, c in found]))])
                words.codes = pa.concat_arrays([words.codes, codes])
                yield pa.RecordBatch.from_arrays([batch.column(2), *_results(vocabulary, words.ids(), with_ids)], names=["row", *_RESULT_NAMES])

    late = rest.select("t", "rare", "row").mapInArrow(second, f"row {row_type}, {_RESULT_SCHEMA}")
    both = done.where("rare is null").select("row", *_RESULT_NAMES).unionByName(late)
    return both.select("row.*", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if with_ids else []))


def _column(chunks: pa.ChunkedArray, kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays([c.cast(kind) for c in chunks.chunks]) if chunks.num_chunks else pa.array([], kind)
