"""Columns of numbers packed into one binary value, for exchanges of very many small records."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def packed(columns: list[np.ndarray], widths: tuple[int, ...]) -> bytes:
    """Equally long columns of numbers below 256 ** width, byte by byte: bytes that hardly vary stand together and
    compress."""
    whole = (c.view(np.uint64) if c.dtype == np.uint64 else c.astype(np.int64) for c in map(np.ascontiguousarray, columns))
    planes = [c.view(np.uint8).reshape(-1, 8)[:, :w].T.tobytes() for c, w in zip(whole, widths)]
    return pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int, widths: tuple[int, ...]) -> list[np.ndarray]:
    """The `n` rows of packed(), as unsigned numbers."""
    planes = np.frombuffer(pa.decompress(data, n * sum(widths), codec="zstd", asbytes=True), dtype=np.uint8).reshape(-1, n)
    out, at = [], 0
    for w in widths:
        whole = np.zeros((n, 8), dtype=np.uint8)
        whole[:, :w] = planes[at : at + w].T
        out.append(whole.view("<u8").ravel())
        at += w
    return out


def parcels(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of few, large values, one in memory at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(column[i].as_py() for column in batch.columns)
