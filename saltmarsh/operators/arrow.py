"""Slices of Arrow batches, so that a task unpacks a bounded part of a batch into Python objects."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters, about, that a task unpacks at once, and rows.
CHARS, ROWS = 1 << 20, 4_096


def _weights(column: pa.Array) -> np.ndarray:
    """Bytes of text of each row of a column of texts or of lists of texts."""
    if not pa.types.is_list(column.type):
        return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    # A token counts 50 bytes besides its text, as it is an object of its own.
    ends = np.cumsum(np.concatenate([[0], pc.fill_null(pc.binary_length(column.flatten()), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 50]))
    rows = np.cumsum(np.concatenate([[0], pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)]))
    return np.diff(ends[rows])


def sized(batches: Iterable[pa.RecordBatch], column: int, chars: int | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of at most about so many bytes of a column of texts or token lists, a row at least."""
    for batch in batches:
        ends = np.cumsum(np.concatenate([[0], _weights(batch.column(column % batch.num_columns))]))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(ends, ends[at] + (chars or CHARS), "right")) - 1
            to = min(max(at + 1, to), at + ROWS, batch.num_rows)
            yield batch.slice(at, to - at)
            at = to
