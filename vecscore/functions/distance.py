"""Squared distances and bounds, as column expressions and as numpy kernels.

Codes are at most 16,000, so every product and sum of a squared distance is an integer below 2**53
and double-precision matrix products give it exactly; for doubles see pairwise_doubles().
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def squared(a: Column, b: Column) -> Column:
    """Sum of squared differences of two arrays of codes, as bigint."""
    parts = F.zip_with(a, b, lambda x, y: (x.cast("bigint") - y) * (x.cast("bigint") - y))
    return F.aggregate(parts, F.lit(0).cast("bigint"), lambda s, x: s + x)


def pairwise(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of q to all rows of p."""
    q, p = q.astype(np.float64), p.astype(np.float64)
    return np.rint((q**2).sum(1)[:, None] + (p**2).sum(1)[None] - 2 * (q @ p.T))


def pairwise_doubles(q: np.ndarray, p: np.ndarray, k: int, same: np.ndarray | None) -> np.ndarray:
    """Sums of squared differences of doubles, added in order; infinite where a point is not among the k nearest, or is the same.

    A matrix product, whose rounding is far below the margin, tells which pairs have to be summed.
    """
    qq, pp = (q**2).sum(1), (p**2).sum(1)
    near = qq[:, None] + pp[None] - 2 * (q @ p.T)
    if same is not None:
        near[same] = np.inf
    worst = np.partition(near, k - 1, axis=1)[:, k - 1 : k] if near.shape[1] > k else np.full((len(q), 1), np.inf)
    rows, cols = np.nonzero((near <= worst + 1e-9 * (1 + qq.max() + pp.max())) & np.isfinite(near))
    d = np.zeros(len(rows))
    for i in range(q.shape[1]):
        d += (q[rows, i] - p[cols, i]) ** 2
    near[:] = np.inf
    near[rows, cols] = d
    return near


def box_bounds(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least squared distances of all rows of q to all boxes."""
    out = np.zeros((len(q), len(lo)))
    for i in range(q.shape[1]):
        x = q[:, i : i + 1].astype(np.float64)
        gap = np.maximum(np.maximum(lo[None, :, i] - x, x - hi[None, :, i]), 0)
        out += gap * gap
    return out


def least(d: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k least of each row, ties by id; infinite entries are none."""
    if d.shape[1] > k:
        worst = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
        rows, cols = np.nonzero((d <= worst) & np.isfinite(d))
    else:
        rows, cols = np.nonzero(np.isfinite(d))
    order = np.lexsort((ids[cols], d[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    first = np.searchsorted(rows, np.arange(len(d)))
    keep = np.arange(len(rows)) - first[rows] < k
    return rows[keep], cols[keep]
