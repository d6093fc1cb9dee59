"""Gaussian mixtures with full covariances: all models (components, start) advance in the same passes.

A pass reads the rows once. In each block of rows it takes every model's log densities by Cholesky factors, turns them
into memberships by log-sum-exp, and adds up sizes, sums and products; one small row per component leaves a task. The
driver holds parameters only. Models start from the clusters of K-means starts. Memberships of given parameters are
plain column expressions.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import workers
from . import lloyd

C = F.col
STEPS = 100
TOLERANCE = 1e-3  # of the mean log-likelihood
RIDGE = 1e-6  # added to variances


@dataclass(frozen=True)
class Mixture:
    weights: np.ndarray  # k
    means: np.ndarray  # k, d
    covariances: np.ndarray  # k, d, d
    start: int = 0
    likelihood: float = -math.inf  # of the parameters before the last step, summed over the rows
    rows: float = 0.0
    trace: tuple[float, ...] = ()  # mean log-likelihood before each step
    still: bool = False

    @property
    def k(self) -> int:
        return len(self.weights)

    def free(self) -> float:
        k, d = self.means.shape
        return (k - 1) + k * d + k * d * (d + 1) / 2

    def bic(self) -> float:
        return -2.0 * self.likelihood + self.free() * math.log(self.rows)

    def factors(self) -> np.ndarray:
        """Inverse Cholesky factors of the covariances."""
        return np.linalg.inv(np.linalg.cholesky(self.covariances))


def _log_densities(models: Sequence[Mixture]) -> Callable[[np.ndarray], np.ndarray]:
    """A function from rows to the log densities of all components of all models, one matrix product for all."""
    means = np.concatenate([m.means for m in models])
    factors = np.concatenate([m.factors() for m in models])
    dims = means.shape[1]
    stacked = factors.reshape(-1, dims).T
    moved = np.einsum("cij,cj->ci", factors, means)
    fixed = np.log(np.diagonal(factors, axis1=1, axis2=2)).sum(axis=1) - 0.5 * dims * math.log(2 * math.pi)
    with np.errstate(divide="ignore"):
        fixed = fixed + np.log(np.concatenate([m.weights for m in models]))

    def told(x: np.ndarray) -> np.ndarray:
        z = (x @ stacked).reshape(len(x), len(means), dims) - moved
        return fixed - 0.5 * np.einsum("rci,rci->rc", z, z)

    return told


def _names(dims: int) -> list[str]:
    return ["n", *[f"s{j}" for j in range(dims)], *[f"p{i}_{j}" for i in range(dims) for j in range(i + 1)]]


def _sums(rows: DataFrame, dims: int, sizes: Sequence[int], member) -> dict:
    """One pass: per model and component the sums of memberships, of values and of their products, and likelihoods.

    ``member(x)`` gives the memberships in all components of all models, side by side, and each model's log-likelihood
    of a block of rows.
    """
    names = _names(dims)
    lower = [(i, j) for i in range(dims) for j in range(i + 1)]

    def run(batches):
        total = np.zeros((sum(sizes), len(names)))
        likelihood = np.zeros(len(sizes))
        for (x,) in lloyd.blocks(batches, "features"):
            products = np.stack([x[:, i] * x[:, j] for i, j in lower], axis=1)
            table = np.concatenate([np.ones((len(x), 1)), x, products], axis=1)
            shares, logs = member(x)
            total += shares.T @ table
            likelihood += logs
        model = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        component = np.concatenate([np.arange(k, dtype=np.int32) for k in sizes])
        log = np.where(component == 0, likelihood[model], 0.0)
        yield pa.RecordBatch.from_pydict({"model": model, "component": component, "log": log, **dict(zip(names, total.T.copy()))})

    workers(rows.sparkSession)
    schema = "model int, component int, log double, " + ", ".join(f"{n} double" for n in names)
    told = rows.select("features").mapInArrow(run, schema)
    told = told.groupBy("model", "component").agg(*[F.sum(n).alias(n) for n in ("log", *names)])
    return {(r["model"], r["component"]): r.asDict() for r in told.collect()}


def _parameters(lines: list[dict], dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    names = _names(dims)
    table = np.array([[line[n] for n in names] for line in lines])
    n = table[:, 0] + 10 * np.finfo(float).eps
    means = table[:, 1 : 1 + dims] / n[:, None]
    covariances = np.zeros((len(lines), dims, dims))
    at = 1 + dims
    for i in range(dims):
        for j in range(i + 1):
            covariances[:, i, j] = covariances[:, j, i] = table[:, at] / n - means[:, i] * means[:, j]
            at += 1
    covariances += RIDGE * np.eye(dims)
    return n / n.sum(), means, covariances, float(table[:, 0].sum())


def of_clusters(rows: DataFrame, models: Sequence[lloyd.Model]) -> list[Mixture]:
    """Mixtures whose components are the clusters of K-means models."""
    dims = len(models[0].centres[0])

    def member(x):
        labels = [lloyd.nearest(x, np.array([m.centres]))[:, 0] for m in models]
        return np.concatenate([np.eye(m.k)[label] for m, label in zip(models, labels)], axis=1), np.zeros(len(models))

    sums = _sums(rows, dims, [m.k for m in models], member)
    out = []
    for i, m in enumerate(models):
        weights, means, covariances, n = _parameters([sums[i, c] for c in range(m.k)], dims)
        out.append(Mixture(weights, means, covariances, m.start, rows=n))
    return out


def of_labels(rows: DataFrame, label: str, labels: Sequence[str], dims: int) -> Mixture:
    """The mixture whose components are given groups: their shares, means and covariances in one aggregate."""
    x = [F.get("features", j) for j in range(dims)]
    cells = {"n": F.lit(1.0)} | {f"s{j}": x[j] for j in range(dims)} | {f"p{i}_{j}": x[i] * x[j] for i in range(dims) for j in range(i + 1)}
    found = {
        r[label]: r.asDict()
        for r in rows.where(C(label).isin(list(labels))).groupBy(label).agg(*[F.sum(e).alias(n) for n, e in cells.items()]).collect()
    }
    lines = [found[name] for name in labels if name in found]
    weights, means, covariances, n = _parameters(lines, dims)
    return Mixture(weights, means, covariances, rows=n)


def step(rows: DataFrame, models: Sequence[Mixture]) -> list[Mixture]:
    """One EM step of all models, in one pass; ``likelihood`` is that of the parameters given."""
    densities = _log_densities(models)
    first = np.cumsum([0, *[m.k for m in models[:-1]]])
    model = np.repeat(np.arange(len(models)), [m.k for m in models])

    def member(x):
        log = densities(x)
        most = np.maximum.reduceat(log, first, axis=1)
        share = np.exp(log - most[:, model])
        whole = np.add.reduceat(share, first, axis=1)
        return share / whole[:, model], (most + np.log(whole)).sum(axis=0)

    dims = models[0].means.shape[1]
    sums = _sums(rows, dims, [m.k for m in models], member)
    out = []
    for i, m in enumerate(models):
        weights, means, covariances, n = _parameters([sums[i, c] for c in range(m.k)], dims)
        likelihood = sums[i, 0]["log"]
        trace = (*m.trace, likelihood / n)
        still = len(trace) > 1 and abs(trace[-1] - trace[-2]) < TOLERANCE
        out.append(Mixture(weights, means, covariances, m.start, likelihood, n, trace, still))
    return out


def fit(rows: DataFrame, ks: Sequence[int], starts: int = 10, steps: int = STEPS, id_col: str = "player_id") -> dict[int, Mixture]:
    """Per number of components the mixture of greatest likelihood over all starts, of equal ones the first start."""
    clusters = lloyd.advance(rows, lloyd.first_models(rows, ks, starts, id_col=id_col))
    models = of_clusters(rows, clusters) if clusters else []
    for _ in range(steps):
        moving = [i for i, m in enumerate(models) if not m.still]
        if not moving:
            break
        for i, m in zip(moving, step(rows, [models[i] for i in moving])):
            models[i] = m
    out: dict[int, Mixture] = {}
    for m in sorted(models, key=lambda m: (m.k, -round(m.likelihood, 6), m.start)):
        out.setdefault(m.k, m)
    return out


def log_densities(model: Mixture, features: str = "features") -> Column:
    """Array of each component's log of weight times density."""
    ways = []
    for c, factor in enumerate(model.factors()):
        squares = []
        for line in factor:
            terms = F.zip_with(features, F.array(*[F.lit(float(v)) for v in line]), lambda x, v: x * v)
            z = F.aggregate(terms, F.lit(0.0), lambda a, b: a + b) - F.lit(float(line @ model.means[c]))
            squares.append(z)
        total = F.aggregate(F.array(*squares), F.lit(0.0), lambda a, b: a + b * b)
        fixed = math.log(model.weights[c]) + np.log(np.diag(factor)).sum() - 0.5 * len(factor) * math.log(2 * math.pi)
        ways.append(F.lit(float(fixed)) - 0.5 * total)
    return F.array(*ways)


def with_memberships(df: DataFrame, model: Mixture, features: str = "features") -> DataFrame:
    """``membership`` of each component, the likeliest ``component``, its ``confidence``, ``entropy`` and the row's ``log_density``."""
    df = df.withColumn("_log", log_densities(model, features)).withColumn("_most", F.array_max("_log"))
    df = df.withColumn("_share", F.transform("_log", lambda x: F.exp(x - C("_most"))))
    df = df.withColumn("_whole", F.aggregate("_share", F.lit(0.0), lambda a, b: a + b))
    df = df.withColumn("membership", F.transform("_share", lambda x: x / C("_whole")))
    return df.withColumns(
        {
            "component": (F.array_position("_log", C("_most")) - 1).cast("int"),
            "confidence": F.array_max("membership"),
            "entropy": F.aggregate("membership", F.lit(0.0), lambda a, x: a - x * F.log(x + F.lit(1e-12))),
            "log_density": C("_most") + F.log("_whole"),
        }
    ).drop("_log", "_most", "_share", "_whole")
