"""Vectors from Arrow lists, shared by the operators that work on whole matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def by_size(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each size of the lists that are not null or empty and hold finite numbers only."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(lengths)
    odd = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    sound = (lengths > 0) & (odd[ends] == odd[ends - lengths])
    for size in np.unique(lengths[sound]).tolist():
        rows = np.flatnonzero(sound & (lengths == size))
        yield rows, flat[(ends - lengths)[rows][:, None] + np.arange(size)]


def scaled(x: np.ndarray, scale: float, offset: int = 0) -> np.ndarray:
    """floor(scale * x) + offset, which must fit a long."""
    return np.floor(x * scale).astype(np.int64) + offset
