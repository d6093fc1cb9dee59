"""Principal components from one pass of moments, with a certificate.

Means and products of all columns are one aggregate; the driver sees a matrix of columns by columns and takes its
eigenvectors. Each component's sign makes its largest loading (the first of equal ones) positive.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

C = F.col


@dataclass(frozen=True)
class Components:
    """Variances (greatest first), loadings (one row per component) and means of the features."""

    variances: np.ndarray
    loadings: np.ndarray
    means: np.ndarray
    covariance: np.ndarray

    def shares(self) -> np.ndarray:
        return self.variances / (self.variances.sum() or 1.0)

    def certificate(self) -> dict[str, float]:
        """How far the components are from solving the problem, and two sums that the covariances give by themselves."""
        left = self.covariance @ self.loadings.T - self.loadings.T * self.variances
        apart = self.loadings @ self.loadings.T - np.eye(len(self.variances))
        return {
            "trace": float(self.variances.sum()),
            "square": float((self.variances**2).sum()),
            "residual": float(np.abs(left).max()),
            "apart": float(np.abs(apart).max()),
        }


def moments(rows: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Means, sample covariances and number of rows of a feature array, in one aggregate."""
    x = [F.get("features", j) for j in range(dims)]
    cells = {"n": F.count(F.lit(1))} | {f"s{j}": F.sum(x[j]) for j in range(dims)}
    cells |= {f"p{i}_{j}": F.sum(x[i] * x[j]) for i in range(dims) for j in range(i + 1)}
    line = rows.agg(*[e.alias(n) for n, e in cells.items()]).first()
    n = line["n"]
    means = np.array([(line[f"s{j}"] or 0.0) / max(n, 1) for j in range(dims)])
    covariance = np.zeros((dims, dims))
    for i in range(dims):
        for j in range(i + 1):
            product = (line[f"p{i}_{j}"] or 0.0) - n * means[i] * means[j]
            covariance[i, j] = covariance[j, i] = product / max(n - 1, 1)
    return means, covariance, n


def principal(rows: DataFrame, dims: int) -> Components:
    means, covariance, _ = moments(rows, dims)
    variances, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-variances, kind="stable")
    loadings = vectors[:, order].T
    size = np.abs(loadings)
    lead = (size >= size.max(axis=1, keepdims=True) - 1e-9).argmax(axis=1)
    signs = np.where(loadings[np.arange(dims), lead] < 0, -1.0, 1.0)
    return Components(variances[order], loadings * signs[:, None], means, covariance)


def with_scores(df: DataFrame, found: Components, n: int, features: str = "features") -> DataFrame:
    """Scores ``pc1`` to ``pcn`` of each row."""
    out = {}
    for i, line in enumerate(found.loadings[:n]):
        terms = F.zip_with(features, F.array(*[F.lit(float(v)) for v in line]), lambda x, v: x * v)
        out[f"pc{i + 1}"] = F.aggregate(terms, F.lit(0.0), lambda a, b: a + b) - F.lit(float(line @ found.means))
    return df.withColumns(out)


def loading_rows(found: Components, columns: Sequence[str], n: int) -> list[tuple[str, str, float]]:
    return [(f"PC{i + 1}", c, float(found.loadings[i, j])) for i in range(n) for j, c in enumerate(columns)]


def top_loadings(rows: DataFrame, top: int = 3) -> DataFrame:
    """Largest loadings of each component by size; a component has one row per feature."""
    ordered = F.slice(F.array_sort(F.collect_list(F.struct((-F.abs("loading")).alias("o"), C("feature"), C("loading")))), 1, top)
    told = rows.groupBy("component").agg(ordered.alias("t")).select("component", F.posexplode("t").alias("place", "e"))
    return told.select("component", "place", "e.feature", "e.loading")
