"""Whitening of vectors: sums and cross products are aggregated in Spark, the small matrix is solved on the driver.

Defined cases: null vectors and vectors of another length than ``dim`` give no row; fewer than two rows pass through with unit norm; zero
vectors stay zero; the memory needed depends on the dimension only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def moments(vectors: DataFrame, dim: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, sum and cross-product sum of the unit vectors; one row of dim * (dim + 1) numbers per partition comes back."""

    def partial(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, xx = 0, np.zeros(dim), np.zeros((dim, dim))
        for part in parts:
            if len(part):
                x = _unit(np.stack(part["vec"]).astype(float))
                n, s, xx = n + len(x), s + x.sum(axis=0), xx + x.T @ x
        yield pd.DataFrame({"n": [n], "i": [0], "v": [np.concatenate([s, xx.ravel()])]})

    rows = vectors.filter(F.col("vec").isNotNull() & (F.size("vec") == dim)).select("vec").mapInPandas(partial, "n bigint, i int, v array<double>")
    total = rows.select("n", F.posexplode("v").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).toPandas().sort_values("k")
    if not len(total):
        return 0, np.zeros(dim), np.zeros((dim, dim))
    flat = total["x"].to_numpy()
    return int(total["n"].iloc[0]), flat[:dim], flat[dim:].reshape(dim, dim)


def whitening_matrix(n: int, total: np.ndarray, cross: np.ndarray, components: int = 128, shrinkage: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """(mean, matrix) of the regularised principal-component whitening."""
    d = len(total)
    mean = total / n
    scatter = cross - n * np.outer(mean, mean)
    values, basis = np.linalg.eigh((scatter + scatter.T) / 2)
    k = min(components, d, n - 1)
    order = np.argsort(values)[::-1][:k]
    return mean, basis[:, order] / np.sqrt(np.maximum(values[order], 0) / (n - 1) + shrinkage)


def whitened(vectors: DataFrame, dim: int, components: int = 128, shrinkage: float = 0.1) -> DataFrame:
    """(id, vec) with whitened unit vectors."""
    n, total, cross = moments(vectors, dim)
    mean, matrix = whitening_matrix(n, total, cross, components, shrinkage) if n >= 2 else (np.zeros(dim), np.eye(dim))
    return apply_background(vectors, dim, mean, matrix)


def apply_background(vectors: DataFrame, dim: int, mean: np.ndarray, matrix: np.ndarray) -> DataFrame:
    """(id, vec): unit vectors shifted by ``mean``, mapped by ``matrix``, scaled to unit norm."""
    shared = vectors.sparkSession.sparkContext.broadcast((mean, matrix))

    def convert(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, w = shared.value
        for part in parts:
            if len(part):
                yield pd.DataFrame({"id": part["id"], "vec": list(_unit((_unit(np.stack(part["vec"]).astype(float)) - m) @ w))})

    return vectors.filter(F.col("vec").isNotNull() & (F.size("vec") == dim)).select("id", "vec").mapInPandas(convert, "id bigint, vec array<double>")
