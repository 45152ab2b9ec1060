"""Packed arrays: one row of bytes per (bucket, block of documents) where a row per entry would cost ten times as much to shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard

ROW = "bucket int, block long, kind int, n int, data binary, more binary"


def put(a: np.ndarray) -> bytes:
    """Bytes of an unsigned array by planes, so that its high bytes lie together and compress."""
    a = np.ascontiguousarray(a)
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def get(b: bytes, dtype, n: int, at: int = 0) -> np.ndarray:
    """The array of ``n`` values that ``put`` made, from place ``at`` of the bytes."""
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8, n * size, at).reshape(size, n).T).view(dtype).ravel()


def put_sorted(a: np.ndarray) -> bytes:
    return put(np.diff(a, prepend=a.dtype.type(0)))


def get_sorted(b: bytes, dtype, n: int, at: int = 0) -> np.ndarray:
    return np.cumsum(get(b, dtype, n, at), dtype=dtype)


def emit(rows: list[tuple]) -> pa.RecordBatch:
    """Rows (bucket, block, kind, n, data, more) as a batch; the bytes are compressed here, as shuffles code no entropy."""
    types = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    small = zstandard.ZstdCompressor(level=1).compress
    columns = [list(c) for c in zip(*rows)]
    columns[4], columns[5] = [small(x) for x in columns[4]], [small(x) for x in columns[5]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["bucket", "block", "kind", "n", "data", "more"])


def rows_of(t: pa.Table) -> list[tuple]:
    """The rows that ``emit`` made."""
    whole = zstandard.ZstdDecompressor().decompress
    columns = [t.column(c).to_pylist() for c in ("bucket", "block", "kind", "n", "data", "more")]
    columns[4], columns[5] = [whole(x) for x in columns[4]], [whole(x) for x in columns[5]]
    return list(zip(*columns))
