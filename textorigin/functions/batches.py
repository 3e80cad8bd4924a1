"""Arrow batches in bounded slices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def slices(column: pa.Array, values: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose arrays hold about ``values`` values together; a longer row is a range of its own."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    low = 0
    while low < len(ends):
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + values, "right")))
        yield low, high
        low = high
