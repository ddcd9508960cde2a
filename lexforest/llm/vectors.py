"""Vectors of the search operators: cleaning, pivots, and blocks of rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(embeddings: DataFrame, allow_zero: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """vec_id, v (array<double>) and the columns keep of the rows whose vector is there, of finite components, and of the usual length.

    The usual length is that of most rows, ties to the longer; a vector of another length has no product with those.
    """
    df = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), *keep)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    df = df.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~F.coalesce(F.exists("v", bad), F.lit(False)))
    if not allow_zero:
        df = df.where(F.exists("v", lambda x: x != 0))
    lengths = df.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1)
    found = lengths.first()
    return df.where(F.size("v") == (found["n"] if found else 0))


def bounded_sample(df: DataFrame, n: int, seed: int) -> np.ndarray:
    """At most n vectors, in the order of a hash of vec_id."""
    rows = df.orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id").select("v").limit(n).collect()
    return np.array([r.v for r in rows]) if rows else np.zeros((0, 0))


def choose_pivots(df: DataFrame, n: int, seed: int) -> np.ndarray:
    """At most n distinct vectors, by the smallest hash of vec_id."""
    rows = bounded_sample(df, n, seed)
    return np.unique(rows, axis=0) if len(rows) else rows


def matrix(column) -> np.ndarray:
    """Rows of an Arrow list<double> column; all of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products of rows of whole numbers held as doubles, exact at any size that fits 64 bits."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if top < 2**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def top_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k largest of each row of scores, ties to the smaller id."""
    n = scores.shape[1]
    if n <= k:
        return np.stack([np.lexsort((ids, -row)) for row in scores]) if len(scores) else np.zeros((0, n), np.int64)
    out = np.empty((len(scores), k), np.int64)
    kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
    for r, row in enumerate(scores):
        near = np.flatnonzero(row >= kth[r])
        out[r] = near[np.lexsort((ids[near], -row[near]))[:k]]
    return out
