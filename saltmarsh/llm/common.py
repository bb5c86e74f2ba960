"""What the corpus operators share: hash splits, slices of batches and bounded word memos, besides the library's written tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..storage import discard, scratch, shared_dir, written

__all__ = ["Memo", "SLICE", "SLICE_BYTES", "WORD", "discard", "hash_key", "remainder", "scratch", "shared_dir", "sized_slices", "slices", "written"]

#: White space of the contracts: a word is a maximal run of anything else.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes that a Python task handles at once; keeps the memory of a batch of long texts small.
SLICE, SLICE_BYTES = 256, 4 << 20


def remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of doc_id as text, mod ``mod``; null for a null doc_id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(mod)


def hash_key(seed: str, *parts: Column) -> Column:
    """A uniform 60-bit key from md5, so that other SQL engines can compute the same."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of at most so many rows and bytes, one row at least."""

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if batch.num_rows <= 1 or batch.nbytes <= size:
            yield batch
        else:
            half = batch.num_rows // 2
            yield from cut(batch.slice(0, half))
            yield from cut(batch.slice(half))

    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield from cut(batch.slice(at, rows))


def sized_slices(batches: Iterable[pa.RecordBatch], column: int, chars: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Slices of at most about so many bytes of text in a column, a row at least."""
    for batch in batches:
        ends = np.cumsum([0, *(n or 0 for n in pc.binary_length(batch.column(column)).to_pylist())])
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + chars, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


class Memo(dict):
    """word -> value(word), kept for the last ``limit`` to twice ``limit`` words of at most ``longest`` characters."""

    def __init__(self, value: Callable, limit: int = 250_000, longest: int = 48):
        super().__init__()
        self.value, self.limit, self.longest, self.older = value, limit, longest, {}

    def __missing__(self, word):
        if (found := self.older.get(word)) is None:
            found = self.value(word)
        if len(word) <= self.longest:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[word] = found
        return found
