"""Symbols of Arrow string columns as numpy arrays: for counts that generated code has no fast expression for."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def rows_of_bytes(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for ranges of rows with about ``most`` bytes; nulls are empty."""
    column = column.fill_null(b"" if pa.types.is_binary(column.type) else "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, end, raw[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def points(text: str | None) -> np.ndarray:
    """The code points of a text."""
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
