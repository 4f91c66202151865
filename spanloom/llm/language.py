"""Language identification by prediction by partial matching.

For each language a tree of byte contexts of variable order (0 to `order`) is counted once over labelled texts and then
frozen. A byte's code length is taken at the longest context that the tree has; a byte unseen there costs the escape
(method C: distinct successors over successors plus distinct) and falls back to the next shorter context, down to a
uniform code. A text goes to the language that codes it in the fewest bits.

All trees are merged into one table per order whose rows hold the resolved code length in every language, so that scoring
a text is a few vectorised lookups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import Scratch, slices

ORDER = 4
#: Labelled texts that are fitted for each language, on average (they are chosen by a hash of their ids): the bound on the fit.
SAMPLE_PER_LANGUAGE = 600
#: Languages that are counted at a time, and the most cells (contexts and grams of all languages of a model, times languages) of one
#: model, 256 MB. Further languages are learned in further models, and a text goes to the best language of all of them.
PANEL, CELLS = 24, 1 << 26
#: A context of order 2 or more needs so many occurrences in its language to stay in the tree.
LEAST_COUNT = 2
#: Score: the posterior with evidence limited to so many bytes, so that it does not saturate on long texts.
EVIDENCE_BYTES = 48
UNKNOWN = "und"
_PAD = b"\n" * ORDER
_LENGTH_SHIFT = np.uint64(48)
#: Code lengths that are held at a time: positions of texts times languages.
_HELD = 1 << 24


def _buffer(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased texts in one byte array, each after a pad; their starts and ends in it."""
    parts = [t.lower().encode("utf-8", "replace") for t in texts]
    lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    data = np.frombuffer(_PAD + _PAD.join(parts), dtype=np.uint8)
    ends = np.cumsum(lengths + ORDER)
    return data, ends - lengths, ends


def _grams(data: np.ndarray, length: int) -> np.ndarray:
    """At each byte, it and its `length` - 1 predecessors as one number, tagged with the length."""
    out = np.zeros(len(data), dtype=np.uint64)
    for back in range(length - 1, -1, -1):
        out <<= np.uint64(8)
        out[back:] |= data[: len(data) - back]
    return out | (np.uint64(length) << _LENGTH_SHIFT)


class _Lookup:
    """Row numbers of keys, by open addressing."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(10, int(len(keys) * 4).bit_length())
        self.slots = np.full(1 << self.bits, -1, dtype=np.int32)
        rest, place = np.arange(len(keys)), self._home(keys)
        while len(rest):
            free = self.slots[place] < 0
            self.slots[place[free]] = rest[free]  # of several for one slot the last stays
            lost = self.slots[place] != rest
            rest, place = rest[lost], (place[lost] + 1) & (len(self.slots) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """-1 for a key that is not there."""
        if not len(self.keys):
            return np.full(len(keys), -1, dtype=np.int32)
        place = self._home(keys)
        found = self.slots[place]
        open_ = np.flatnonzero((found >= 0) & (self.keys[found] != keys))
        while len(open_):
            place[open_] = (place[open_] + 1) & (len(self.slots) - 1)
            found[open_] = self.slots[place[open_]]
            open_ = open_[(found[open_] >= 0) & (self.keys[found[open_]] != keys[open_])]
        return found


@dataclass
class Model:
    """Frozen statistics: per order the known grams with their code lengths, and the known contexts with their escapes."""

    languages: list[str]
    grams: list[tuple[np.ndarray, np.ndarray]]
    escapes: list[tuple[np.ndarray, np.ndarray]]

    @staticmethod
    def fit(counts: pd.DataFrame) -> Model:
        """counts: columns lang, gram (tagged), n."""
        languages = sorted(counts["lang"].unique())
        lang = counts["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy()
        gram = counts["gram"].to_numpy(dtype=np.int64).view(np.uint64)
        n = counts["n"].to_numpy(dtype=np.float64)
        model = Model(languages, [], [])
        for order in range(ORDER + 1):
            mine = (gram >> _LENGTH_SHIFT) == order + 1
            g, l, c = gram[mine], lang[mine], n[mine]
            context = ((g & ((np.uint64(1) << _LENGTH_SHIFT) - np.uint64(1))) >> np.uint64(8)) | (np.uint64(order) << _LENGTH_SHIFT)
            keys, at = np.unique(context, return_inverse=True)
            total, kinds = np.zeros((len(keys), len(languages))), np.zeros((len(keys), len(languages)))
            np.add.at(total, (at, l), c)
            np.add.at(kinds, (at, l), 1)
            known = total >= (LEAST_COUNT if order >= 2 else 1)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(known, np.log2((total + kinds) / kinds), 0.0)
            top, where = np.unique(g, return_inverse=True)
            seen = np.zeros((len(top), len(languages)))
            np.add.at(seen, (where, l), c)
            of = np.empty(len(top), dtype=np.int64)
            of[where] = at
            lower = model._resolve(order - 1, top)
            with np.errstate(divide="ignore", invalid="ignore"):
                direct = np.log2((total[of] + kinds[of]) / seen)
            cost = np.where(known[of] & (seen > 0), direct, escape[of] + lower)
            keep, held = known.any(axis=1), known[of].any(axis=1)
            model.escapes.append((keys[keep], escape[keep].astype(np.float32)))
            model.grams.append((top[held], cost[held].astype(np.float32)))
            model._tables = None
        return model

    _tables: list[tuple[_Lookup, _Lookup]] | None = None
    more: list[Model] = field(default_factory=list)

    def tables(self) -> list[tuple[_Lookup, _Lookup]]:
        if self._tables is None or len(self._tables) != len(self.grams):
            self._tables = [(_Lookup(g[0]), _Lookup(e[0])) for g, e in zip(self.grams, self.escapes, strict=True)]
        return self._tables

    def _resolve(self, order: int, grams: np.ndarray) -> np.ndarray:
        """Code lengths of the grams' last bytes after at most `order` predecessors."""
        out = np.zeros((len(grams), len(self.languages)), dtype=np.float32)
        rest = np.arange(len(grams))
        bytes_ = grams & ((np.uint64(1) << _LENGTH_SHIFT) - np.uint64(1))
        for k in range(order, -1, -1):
            grams_at, escapes_at = self.tables()[k]
            own = bytes_[rest] & ((np.uint64(1) << np.uint64(8 * (k + 1))) - np.uint64(1))
            row = grams_at.find(own | (np.uint64(k + 1) << _LENGTH_SHIFT))
            hit = row >= 0
            out[rest[hit]] += self.grams[k][1][row[hit]]
            rest, own = rest[~hit], own[~hit]
            if not len(rest):
                return out
            row = escapes_at.find((own >> np.uint64(8)) | (np.uint64(k) << _LENGTH_SHIFT))
            hit = row >= 0
            out[rest[hit]] += self.escapes[k][1][row[hit]]
        out[rest] += 8.0
        return out

    def bits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Code length of each text in each language; and the texts' bytes. Texts must not be empty. Bytes are coded a stretch
        at a time, with their contexts, so that a long text takes no more memory than a short one but for itself."""
        data, starts, ends = _buffer(texts)
        sums, step = np.zeros((len(texts), len(self.languages))), max(4096, _HELD // len(self.languages))
        for a in range(0, len(data), step):
            b, lo = min(a + step, len(data)), max(0, a - ORDER)
            i, j = np.searchsorted(ends, a, "right"), np.searchsorted(starts, b, "left")
            if i == j:
                continue
            cost = self._resolve(ORDER, _grams(data[lo:b], ORDER + 1)[a - lo :])
            bounds = np.stack([np.maximum(starts[i:j], a), np.minimum(ends[i:j], b)], axis=1).ravel() - a
            sums[i:j] += np.add.reduceat(cost, bounds[:-1] if bounds[-1] == b - a else bounds, axis=0, dtype=np.float64)[::2]
        return sums, ends - starts

    def evidence(self, texts: list[str | None]) -> tuple[np.ndarray, list[str | None], np.ndarray, np.ndarray]:
        """For each text the least code length, its language, the posterior mass of all languages relative to it, and the share of
        the evidence that counts. Without letters or languages: infinity, None, 0, 1."""
        least, mass, share = np.full(len(texts), np.inf), np.zeros(len(texts)), np.ones(len(texts))
        labels: list[str | None] = [None] * len(texts)
        rows = [i for i, t in enumerate(texts) if t is not None and any(map(str.isalpha, t))]
        if rows and self.languages:
            sums, lengths = self.bits([texts[i] for i in rows])
            least[rows], share[rows] = sums.min(axis=1), np.minimum(1.0, EVIDENCE_BYTES / lengths)
            mass[rows] = np.exp2(-np.minimum((sums - least[rows][:, None]) * share[rows][:, None], 1000.0)).sum(axis=1)
            for i, b in zip(rows, sums.argmin(axis=1).tolist(), strict=True):
                labels[i] = self.languages[b]
        return least, labels, mass, share

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """By this model's languages alone."""
        _, labels, mass, _ = self.evidence(texts)
        with np.errstate(divide="ignore"):
            return [UNKNOWN if x is None else x for x in labels], np.where(mass > 0, 1.0 / mass, 0.0)


def held_out(id_col: str = "doc_id") -> F.Column:
    """Rows that are never learned from: crc32 of the id's text divisible by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE_PER_LANGUAGE, panel: int = PANEL, cells: int = CELLS) -> Model:
    """Fits on about `sample` whole texts of each language, chosen by a hash of their ids among the rows that are not held out.

    Every value of the label counts as a language; without labelled texts there are none. The driver holds the names of all
    languages, and counts `panel` of them at a time, in order of their names. A model has so many languages that its tables keep
    within `cells` (one at least); models beyond the first follow in `more`."""
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("i"), F.col(text).alias("t"), F.col(lang).alias("l"))
    sizes = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}  # a row for each language
    names = sorted(sizes)
    models = [m for k in range(0, len(names), panel) for m in _fit(rows, {l: sizes[l] for l in names[k : k + panel]}, sample, cells)]
    if not models:
        return Model([], [], [])
    models[0].more = models[1:]
    return models[0]


def _fit(rows: DataFrame, sizes: dict[str, int], sample: int, cells: int) -> list[Model]:
    """rows: i, t, l. Models of the languages of `sizes`, which has their numbers of texts."""
    unit = 1 << 30
    share = F.create_map(*[F.lit(x) for l, n in sizes.items() for x in (l, min(unit, -(-unit * sample // n)))])
    chosen = rows.where(F.pmod(F.xxhash64("i", F.lit("sample")), F.lit(unit)) < share[F.col("l")]).select("t", "l")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 0):
                texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for l in sorted(set(langs)):
                    own = [t for t, x in zip(texts, langs, strict=True) if x == l and t]
                    if not own:
                        continue
                    data, starts, ends = _buffer(own)
                    inside = np.zeros(len(data) + 1, dtype=np.int64)
                    np.add.at(inside, starts, 1)
                    np.add.at(inside, ends, -1)
                    inside = np.cumsum(inside[:-1]) > 0
                    for k in range(1, ORDER + 2):
                        keys, n = np.unique(_grams(data, k)[inside], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([l] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    counts = chosen.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found = counts.toArrow().to_pandas()
    grams = found.groupby("lang").size().sort_index()
    models, at = [], 0
    while at < len(grams):  # a table has a row for each gram of any of its languages at most, and as many for contexts
        n = next((k for k in range(len(grams) - at, 1, -1) if 2 * k * int(grams.iloc[at : at + k].sum()) <= cells), 1)
        models.append(Model.fit(found[found["lang"].isin(grams.index[at : at + n])]))
        at += n
    return models


def identify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` with lang_pred and score, for each row.

    Null texts and texts without a letter give `und` and 0. Repeated rows give repeated results; an empty table gives an
    empty result; columns other than `keep` and the text are not read. Ties go to the first language in order.
    """
    keep = docs.columns if keep is None else keep
    rows = docs.select(F.col(text).alias("_text"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"))
    schema = f"_text string, _row {rows.schema['_row'].dataType.simpleString()}, _least double, _label string, _mass double"
    panels = [model, *model.more]
    for k, part in enumerate(panels):
        if k:  # one panel's model at a time in a task
            rows = Scratch(docs.sparkSession, "language").table(rows, f"panel{k}")
        rows = rows.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(replace(part, more=[])), k == len(panels) - 1), schema)
    score = F.when(F.col("_mass") > 0, 1 / F.col("_mass")).otherwise(0.0)
    return rows.select("_row.*", F.coalesce("_label", F.lit(UNKNOWN)).alias("lang_pred"), score.alias("score"))


def _score(shared: Broadcast, last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds _least, _label and _mass, or improves on those of the panels before. After the last panel the text is not needed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted: Model = shared.value
        for whole in batches:
            for batch in slices(whole, 0, 1 << 20):
                least, labels, mass, share = fitted.evidence(batch.column(0).to_pylist())
                if batch.num_columns > 2:
                    old, names, weight = np.asarray(batch.column(2)), batch.column(3).to_pylist(), np.asarray(batch.column(4))
                    best = np.minimum(old, least)
                    part = lambda bits, m: np.where(np.isfinite(bits), m * np.exp2(-np.minimum((bits - np.where(np.isfinite(best), best, 0)) * share, 1000.0)), 0.0)  # noqa: B023, E731
                    labels = [a if x <= y else b for a, b, x, y in zip(names, labels, old.tolist(), least.tolist(), strict=True)]
                    least, mass = best, part(old, weight) + part(least, mass)
                texts = pa.nulls(batch.num_rows, pa.string()) if last else batch.column(0)
                yield pa.RecordBatch.from_arrays([texts, batch.column(1), pa.array(least), pa.array(labels, pa.string()), pa.array(mass)], names=["_text", "_row", "_least", "_label", "_mass"])

    return run
