"""Rows of vectors packed into blocks, one row a block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .minhash_dedup import _groups, _spans


def usable(vec: str) -> Column:
    """Whether a vector takes part: not null or empty, all finite, not all zero."""
    finite = F.forall(vec, lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    return F.coalesce(finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def width(df: DataFrame, vec: str) -> int:
    """Most components of a vector; shorter ones count as padded with zeros."""
    return df.agg(F.max(F.size(vec))).first()[0] or 0


def matrix(column, dim: int, dtype=np.float64) -> np.ndarray:
    """A column of lists as rows padded with zeros to ``dim``."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = np.asarray(column.flatten(), dtype)
    if (sizes == dim).all():
        return flat.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim), dtype)
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows divided by their length, safe against overflow."""
    x = x / np.maximum(x.max(1, keepdims=True), -x.min(1, keepdims=True))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    return x


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of paired rows in double precision."""
    x, y = x.astype(np.float64), y.astype(np.float64)
    return (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))


def groups_of(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.Table]]:
    """Each whole group of rows sorted by ``key``."""
    for t in _groups(batches, [key]):
        for i, j in _spans(t, [key]):
            yield t.column(key)[i].as_py(), t.slice(i, j - i)
