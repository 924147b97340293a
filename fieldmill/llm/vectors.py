"""Vectors as exact integers: what the two vector operators share. Every distance and sum is exact, so ties are true ties."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Components beyond this would let a squared distance leave 64 bits.
MOST = 1 << 26


def is_whole(vector: Column) -> Column:
    """Whether a vector is there and has neither null nor non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


def whole_rows(lists: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, floor(scale * component) as int64) of the vectors of `dims` finite components; the others are left out."""
    right = pc.fill_null(pc.equal(pc.list_value_length(lists), dims), False)
    flat = pc.list_flatten(lists.filter(right)).to_numpy(zero_copy_only=False).astype(np.float64)  # nulls come as nan
    rows = flat.reshape(-1, dims)
    finite = np.isfinite(rows).all(axis=1)
    ints = np.floor(rows[finite] * scale)
    if np.abs(ints).max(initial=0) >= MOST:
        raise ValueError(f"a component of {MOST / scale} or more: its squared distances don't fit 64 bits")
    return np.flatnonzero(right.to_numpy(zero_copy_only=False))[finite], ints.astype(np.int64)


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x from the rows of y at the same places (or from the one row y)."""
    off = x - y
    return np.einsum("ij,ij->i", off, off)


def all_apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x from all rows of y: as float products where these hold every integer met."""
    top = max(np.abs(x).max(initial=0), np.abs(y).max(initial=0))
    if 4 * x.shape[1] * int(top) ** 2 < 1 << 52:
        product = (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
        return (x * x).sum(axis=1)[:, None] - 2 * product + (y * y).sum(axis=1)[None, :]
    return np.stack([apart(x, row) for row in y], axis=1) if len(y) else np.zeros((len(x), 0), np.int64)


def root_down(squares: np.ndarray) -> np.ndarray:
    """Integer square roots, rounded down."""
    root = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    if squares.max(initial=0) < 1 << 52:  # the float root of such a square rounds to no larger integer
        return root
    root -= root * root > squares
    return root + ((root + 1) * (root + 1) <= squares)


def root_up(squares: np.ndarray) -> np.ndarray:
    root = root_down(squares)
    return root + (root * root < squares)
