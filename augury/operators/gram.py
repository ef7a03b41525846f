"""Projection on the leading eigenvectors of the Gram matrix, by rounds of matrix-vector products.

The Gram matrix of n centred rows is n by n and is never made. Its eigenvectors are X w for the eigenvectors w of the small matrix between
components, so a round takes the current directions W (components by a few columns) through X' (X W): each task adds up its rows' share, and
what is summed are components times columns numbers, whatever the rows. Between rounds the columns are made orthogonal (deflation of
each by those before it), and turned to the eigenvectors of what they span. A few columns more than asked make rounds few.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import usable
from .cluster import mean_vectors


def _matrix(batch: pa.RecordBatch, at: int) -> np.ndarray:
    return batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def through(rows: DataFrame, mean: np.ndarray, w: np.ndarray) -> np.ndarray:
    """X' X W of centred rows (``v``)."""

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(w)
        for b in batches:
            if b.num_rows:
                x = _matrix(b, 0) - mean
                total += x.T @ (x @ w)
        yield pa.RecordBatch.from_arrays([pa.array(range(w.size), pa.int32()), pa.array(total.ravel())], ["i", "s"])

    out = np.zeros(w.size)
    for r in rows.select("v").mapInArrow(share, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect():
        out[r["i"]] = r["s"]
    return out.reshape(w.shape)


def top_eigen(rows: DataFrame, mean: np.ndarray, k: int, *, spare: int = 8, rounds: int = 200, tolerance: float = 1e-7, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues and their vectors (columns, largest component positive) of X' X, to a residual of ``tolerance`` of the largest."""
    dims = len(mean)
    w = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, min(dims, k + spare))))[0]
    values = np.zeros(min(k, dims))
    for _ in range(rounds):
        moved = through(rows, mean, w)
        small = w.T @ moved
        found, turn = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-found)
        found, moved, w = found[order], moved @ turn[:, order], w @ turn[:, order]
        values = found[:k]
        # how far each is from being an eigenvector
        if np.linalg.norm(moved[:, :k] - w[:, :k] * values, axis=0).max(initial=0.0) <= tolerance * max(values.max(initial=0.0), 1e-300):
            break
        w = np.linalg.qr(moved)[0]
    vectors = w[:, :k]
    return values, vectors * np.sign(vectors[np.abs(vectors).argmax(0), range(vectors.shape[1])])


def projection(df: DataFrame, id_col: str, vec_col: str, k: int = 3, **more) -> tuple[DataFrame, list[float]]:
    """``id_col, projected``: rows on the k leading directions of what sets them apart from their mean; and each direction's share of the
    whole variance. Without rows there is nothing to project."""
    rows = usable(df, id_col, vec_col)
    first = mean_vectors(rows.withColumn("one", F.lit(1)), ["one"], "v").first()
    if first is None:
        return rows.select(F.col("id").alias(id_col), F.col("v").alias("projected")), []
    mean = np.array(first["mean"])
    values, vectors = top_eigen(rows, mean, k, **more)
    whole = rows.agg(F.sum(F.aggregate(F.zip_with("v", F.array(*map(F.lit, mean.tolist())), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))).first()[0]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = (_matrix(b, 1) - mean) @ vectors if b.num_rows else np.zeros((0, k))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(y), pa.list_(pa.float64()))], ["id", "projected"])

    return rows.select("id", "v").mapInArrow(place, "id bigint, projected array<double>").withColumnRenamed("id", id_col), [float(v / whole) if whole else 0.0 for v in values]
