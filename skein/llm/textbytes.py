"""Numpy on the bytes of many texts at once, for use inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are taken together up to so many bytes, so that a task's arrays stay small; a longer text comes alone.
CHUNK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A 64-bit value for each byte value.
BYTE_HASH = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def byte_chunks(column: pa.Array):
    """(first row, bytes, offsets) of runs of texts; null texts are empty."""
    col = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(col)
    if not n:
        return
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1
        end = min(n, max(end, at + 1))
        yield at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end
