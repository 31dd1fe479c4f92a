"""Shared parts of the two vector operators: valid rows, bounded samples, k-means."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def valid(vector: Column) -> Column:
    """Not null, not empty, not all zero, without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def sample(vectors: DataFrame, key: str, rows: int) -> np.ndarray:
    """The vectors with the smallest hashes of ``key``, at most ``rows`` of them, as doubles."""
    got = vectors.select("v", F.xxhash64(key).alias("h"), key).orderBy("h", key).limit(rows).select("v").toArrow().column("v")
    return matrix(got) if len(got) else np.zeros((0, 0))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length as a matrix of doubles."""
    n = len(column)
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(n, -1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Unit centroids of the unit rows ``x``; an empty cell takes the row that fits worst."""
    c = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        s = x @ c.T
        at, fit = s.argmax(axis=1), s.max(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        empty = np.flatnonzero(np.bincount(at, minlength=len(c)) == 0)
        sums[empty] = x[np.argsort(fit, kind="stable")[: len(empty)]]
        c = unit(sums)
    return c


def balanced_kmeans(x: np.ndarray, k: int, rounds: int = 8, weight: float = 0.5, seed: int = 5) -> np.ndarray:
    """Centroids by squared distance plus a penalty for cells that got more than their share in the round before."""
    c = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)].copy()
    over = np.zeros(len(c))
    for _ in range(rounds):
        d = (c * c).sum(1)[None, :] - 2 * x @ c.T
        spread = max(1e-12, float(np.median(d.max(axis=1) - d.min(axis=1))))
        at = (d + weight * spread * over[None, :]).argmin(axis=1)
        n = np.bincount(at, minlength=len(c))
        over = np.clip(n * len(c) / max(1, len(x)) - 1, 0, 2) * 0.5
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c
