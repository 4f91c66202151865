"""Membership filters and batch slicing for the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.shared import Scratch, shared_dir

__all__ = ["KeyFilter", "Scratch", "shared_dir", "slices", "text_key"]

#: Bytes of text that one vectorised step handles; longer single texts form a step of their own.
SLICE_BYTES = 4 << 20
#: The largest filter has 2**24 words, 128 MB; a word takes so many keys before the next size.
_MOST_BITS, _KEYS_PER_WORD = 24, 8


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of the batch whose texts in `column` have about `most` bytes."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    ends = np.cumsum(sizes + 64)
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right"))
        stop = max(start + 1, min(stop, batch.num_rows))
        yield batch.slice(start, stop - start)
        start = stop


def text_key(text: str) -> Column:
    """With the id it names a row; rows that agree on both are one document."""
    return F.xxhash64(F.col(text), F.lit("row"))


# --- membership filters of bounded size -----------------------------------------------------------------------------


class KeyFilter:
    """A blocked Bloom filter over well-mixed long keys, of 2**`bits` 64-bit words.

    It lets every member through and a few others, so an exact join must follow. Its size follows the number of keys, between
    `bits` and _MOST_BITS; beyond that more keys only weaken it.
    """

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def build(keys: DataFrame, column: str, bits: int = 20) -> KeyFilter:
        """Counts the keys, then collects one row per word of the filter at most."""
        bits = min(_MOST_BITS, max(bits, (keys.count() // _KEYS_PER_WORD).bit_length()))
        c = F.col(column)
        mask = F.expr(f"shiftleft(1L, cast(`{column}` & 63 as int)) | shiftleft(1L, cast(shiftright(`{column}`, 6) & 63 as int))")
        found = keys.where(c.isNotNull()).groupBy(F.shiftrightunsigned(c, 64 - bits).alias("w")).agg(F.bit_or(mask).alias("m")).toArrow()
        words = np.zeros(1 << bits, dtype=np.uint64)
        words[found.column("w").to_numpy()] = found.column("m").to_numpy().view(np.uint64)
        return KeyFilter(words)

    def has(self, keys: np.ndarray) -> np.ndarray:
        """keys: int64."""
        k = keys.view(np.uint64)
        bits = np.uint64(64 - (len(self.words).bit_length() - 1))
        one, low = np.uint64(1), np.uint64(63)
        mask = (one << (k & low)) | (one << ((k >> np.uint64(6)) & low))
        return (self.words[(k >> bits).astype(np.int64)] & mask) == mask
