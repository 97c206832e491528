"""Arrow batches in slices of bounded size, for functions in Python."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Characters or bytes that a worker takes at a time, or one row that has more.
AT_ONCE = 1_000_000


def some(batch: pa.RecordBatch | pa.Array, sizes: pa.Array) -> Iterator:
    """Slices of ``batch`` with about AT_ONCE of ``sizes`` each, so that a worker holds Python's objects of a few rows and not of all."""
    whole = np.cumsum(np.asarray(sizes.fill_null(0), np.int64))
    ends = [*(np.flatnonzero(np.diff(whole // AT_ONCE)) + 1), len(whole)]
    for start, end in zip([0, *ends[:-1]], ends):
        if end > start:
            yield batch.slice(start, end - start)
