"""K-means of many models in one pass over the rows, and the figures that compare them.

All models (number of clusters, start, resample) advance together: a pass reads the rows once, sums every
model's clusters inside the task, and one small row per cluster leaves it. The driver holds centres only. The
number of passes is that of the slowest model, whatever the number of models. Coordinates and centres are rounded to
nine places, so the order in which tasks are added up changes nothing. A model ends when its centres' squared moves add
up to no more than ``STILL``.

Starts are drawn by md5 of start and id, resamples are weights of each row, drawn by md5 of repetition and id:
no resample is written. A cluster that loses all rows keeps its centre; equal distances go to the lower cluster number.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settle, workers
from . import digests

C = F.col
DIGITS = 9
STEPS = 100
STILL = 1e-4
DRAW_HEX = 5  # hex digits of a start's md5 that rank the rows for one cluster
WEIGHT_HEX = 8  # hex digits of a repetition's md5 that draw a row's weight
MOST_WEIGHT = 8
BLOCK = 250  # rows whose distances to a stack of models are held at once
STACK = 200  # models of a stack
CELLS, LEAST_BLOCK, MOST_BLOCK = 1 << 18, 64, 4096  # rows of a pass at once, so that their cells (sides of all models) stay near the core
SINGLE = 2.0**-23  # error of the difference of two single-precision products per column, as a share of the norms
CLOSE = 1e-12  # share of the squared norms below which two distances by products cannot be told apart


@dataclass(frozen=True)
class Model:
    """Centres of one model; ``rep`` names the resample whose weights it sees, if any."""

    k: int
    start: int
    centres: tuple[tuple[float, ...], ...]
    rep: int | None = None
    cost: float = math.inf
    steps: int = 0
    still: bool = False


def start_points(rows: DataFrame, starts: int, most: int, id_col: str = "player_id") -> list[list[tuple[float, ...]]]:
    """Per start the rows that become the first centres: for each cluster the least by md5 of start and id.

    Clusters draw apart from each other, so two of them may begin at the same row. Models of fewer clusters use the first ones.
    """
    schema = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("slot", T.IntegerType()), T.StructField("draw", T.LongType())])
    schema = schema.add("_id", rows.schema[id_col].dataType).add("features", rows.schema["features"].dataType)

    def run(batches):
        least: dict[tuple[int, int], tuple] = {}
        for batch in batches:
            texts, ids = digests.Texts(batch.column("_text")), batch.column("_id")
            for start in range(starts if batch.num_rows else 0):
                words = texts.md5(b"%d:" % start)
                for j in range(most):
                    draw = digests.digits(words, DRAW_HEX * j, DRAW_HEX)
                    draw[texts.null] = -1  # nulls come first
                    low = int(draw.min())
                    at = min(np.flatnonzero(draw == low).tolist(), key=lambda i: ids[i].as_py()) if low >= 0 else int(draw.argmin())
                    found = (low, ids[at].as_py(), ids.slice(at, 1), batch.column("features").slice(at, 1))
                    if (start, j) not in least or (low, low < 0 or found[1]) < (old := least[start, j])[:1] + (low < 0 or old[1],):
                        least[start, j] = found
        if least:
            (start, slot), kept = zip(*least), list(least.values())
            draw = pa.array([None if low < 0 else low for low, *_ in kept], pa.int64())
            columns = [pa.array(start, pa.int32()), pa.array(slot, pa.int32()), draw, *(pa.concat_arrays(x) for x in zip(*[k[2:] for k in kept]))]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    workers(rows.sparkSession)
    # a task keeps one row of each start and cluster
    drawn = rows.select(C(id_col).alias("_id"), C(id_col).cast("string").alias("_text"), "features").mapInArrow(run, schema)
    found = drawn.groupBy("start", "slot").agg(F.min_by("features", F.struct("draw", "_id")).alias("c")).collect()
    points = {(r["start"], r["slot"]): tuple(r["c"]) for r in found}
    return [[points[start, j] for j in range(most)] for start in range(starts) if (start, 0) in points]


def with_weights(rows: DataFrame, reps: int, share: float = 0.8, id_col: str = "player_id") -> DataFrame:
    """``weights``, a byte per resample: how often it draws the row, of ``share`` of the rows with replacement (Poisson)."""
    limits = np.array(weight_limits(share))

    def run(batches):
        for batch in batches:
            texts = digests.Texts(batch.column("_text"))
            out = np.empty((batch.num_rows, reps), np.uint8)
            for rep in range(reps):
                draw = digests.digits(texts.md5(b"%d:" % rep), 0, WEIGHT_HEX)
                out[:, rep] = np.searchsorted(limits, draw, side="right")
            out[texts.null] = 0
            ends = np.arange(batch.num_rows + 1, dtype=np.int32) * reps
            weights = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(out)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], weights], [*batch.schema.names[:-1], "weights"])

    workers(rows.sparkSession)
    schema = T.StructType([*rows.schema.fields, T.StructField("weights", T.BinaryType())])
    return rows.withColumn("_text", C(id_col).cast("string")).mapInArrow(run, schema)


def weight_limits(share: float) -> list[int]:
    """Draws from which on a row counts once, twice and so on."""
    out, below, chance = [], 0.0, math.exp(-share)
    for n in range(1, MOST_WEIGHT + 1):
        below += chance
        out.append(round(below * 16**WEIGHT_HEX))
        chance *= share / n
    return out


def blocks(batches: Iterable[pa.RecordBatch], *columns: str, most: int = BLOCK) -> Iterator[list[np.ndarray]]:
    """The named array columns as matrices, ``most`` rows at a time; a binary column holds a byte per value."""
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            some = batch.slice(at, most)
            yield [_matrix(some.column(c)) for c in columns]


def _matrix(column: pa.Array) -> np.ndarray:
    if pa.types.is_binary(column.type):
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        flat = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    else:
        flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(float, copy=False)


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances (rows, ..., clusters) to centres (..., clusters, columns), added up column by column as SQL would."""
    out = np.zeros((len(x), *centres.shape[:-1]))
    spread = (slice(None), *[None] * (centres.ndim - 1))
    for j in range(x.shape[1]):
        apart = x[:, j][spread] - centres[..., j]
        apart *= apart
        out += apart
    return out


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Nearest cluster (rows, models) among centres (models, clusters, columns).

    Distances come from matrix products; where the two least are too close for these, they are added up column by column.
    """
    half = (centres * centres).sum(axis=2) / 2
    # half the squared distances, without the row's own norm
    apart = [half[:, c] - x @ np.ascontiguousarray(centres[:, c].T) for c in range(centres.shape[1])]
    limit = CLOSE * ((x * x).sum(axis=1)[:, None] + (half.max(axis=1) + 1.0))
    limit += np.minimum.reduce(apart)
    label, count = np.zeros(limit.shape, np.int16), np.zeros(limit.shape, np.int16)
    for c, one in enumerate(apart):
        near = one <= limit
        count += near
        label += np.multiply(near, c, dtype=np.int16)
    row, model = np.nonzero(count != 1)
    for at in range(0, len(row), BLOCK * STACK):
        r, m = row[at : at + BLOCK * STACK], model[at : at + BLOCK * STACK]
        label[r, m] = _nearest_exactly(x, centres, r, m)
    return label


def _nearest_exactly(x: np.ndarray, centres: np.ndarray, row: np.ndarray, model: np.ndarray) -> np.ndarray:
    """Nearest cluster of each (row, model), its distances added up column by column."""
    exact = np.zeros((len(row), centres.shape[1]))
    for j in range(x.shape[1]):
        apart = x[row, j][:, None] - centres[model, :, j]
        apart *= apart
        exact += apart
    return exact.argmin(axis=1)


class _Sides:
    """Models of one resample, held as what sets each cluster apart from the first: a normal and an offset.

    Sides are told by products in single precision; where these cannot tell two clusters apart, `_distances` decide.
    """

    def __init__(self, stacks: Sequence[np.ndarray]):
        self.stacks = list(stacks)
        normal, offset = [], []
        for centres in self.stacks:
            half = (centres * centres).sum(axis=2) / 2
            for j in range(1, centres.shape[1]):
                normal.append(centres[:, j] - centres[:, 0])
                # a centre that repeats an earlier one never wins
                again = (centres[:, :j] == centres[:, j : j + 1]).all(axis=2).any(axis=1)
                offset.append(np.where(again, np.inf, half[:, j] - half[:, 0]))
        dims = self.stacks[0].shape[2]
        self.normal = np.concatenate([np.zeros((0, dims)), *normal]).astype(np.float32)
        self.offset = np.concatenate([np.zeros(0), *offset]).astype(np.float32)
        self.columns = len(self.offset)
        reach = np.abs(np.where(np.isinf(self.offset), 0.0, self.offset)).max(initial=0.0)
        size = np.sqrt((self.normal.astype(float) ** 2).sum(axis=1)).max(initial=0.0)
        self.slack = SINGLE * (dims + 4) * np.array([reach, size])

    def sides(self, x: np.ndarray) -> list[np.ndarray]:
        """Per stack (clusters but the first, models, rows): whether the row's nearest centre is that one."""
        apart = self.normal @ np.ascontiguousarray(x.T, dtype=np.float32)
        apart -= self.offset[:, None]
        slack = (self.slack[0] + self.slack[1] * np.sqrt((x * x).sum(axis=1))).astype(np.float32)
        out, at = [], 0
        for centres in self.stacks:
            models, k = centres.shape[:2]
            mine = apart[at : at + (k - 1) * models].reshape(k - 1, models, len(x))
            at += (k - 1) * models
            if k == 1:
                out.append(np.zeros((0, models, len(x)), bool))
                continue
            if k == 2:
                here = mine > 0
                unsure = np.abs(mine[0]) <= slack
            else:
                limit = np.maximum(mine.max(axis=0), 0)
                limit -= slack
                here = mine >= limit
                unsure = here.sum(axis=0, dtype=np.int16) + (limit <= 0) != 1
            found = np.flatnonzero(unsure)
            if len(found):
                model, row = np.divmod(found, len(x))
                for a in range(0, len(row), BLOCK * STACK):
                    m, r = model[a : a + BLOCK * STACK], row[a : a + BLOCK * STACK]
                    here[:, m, r] = _nearest_exactly(x, centres, r, m) == np.arange(1, k)[:, None]
            out.append(here)
        return out

    def add(self, x: np.ndarray, values: np.ndarray, weighted: np.ndarray, out: list[np.ndarray], spread: bool) -> None:
        """Add the rows to ``out``, per stack a table (models, clusters, values); the first cluster gets what the others leave."""
        whole = weighted.sum(axis=0)
        for centres, here, table in zip(self.stacks, self.sides(x), out):
            models, k = centres.shape[:2]
            got = (here.reshape((k - 1) * models, len(x)).astype(float) @ weighted).reshape(k - 1, models, weighted.shape[1])
            table[:, 1:] += got.swapaxes(0, 1)
            table[:, 0] += whole - got.sum(axis=0)
            if spread:
                label = (here * np.arange(1, k)[:, None, None]).sum(axis=0)
                for m in range(models):
                    far = np.sqrt(((x - centres[m][label[m]]) ** 2).sum(axis=1)) * weighted[:, 0]
                    table[m, :, 1] += np.bincount(label[m], far, k)


def _by_rep(models: Sequence[Model]) -> list[tuple[int | None, list[list[int]], list[np.ndarray]]]:
    """Per resample its models' numbers, those of one k together, with their centres stacked; a few models at a time."""
    reps: dict[int | None, list[int]] = {}
    for i, m in enumerate(models):
        reps.setdefault(m.rep, []).append(i)
    out = []
    for rep, mine in reps.items():
        for at in range(0, len(mine), STACK):
            some = _groups([models[i] for i in mine[at : at + STACK]])
            out.append((rep, [[mine[at + i] for i in numbers] for numbers, _ in some], [centres for _, centres in some]))
    return out


def _groups(models: Sequence[Model]) -> list[tuple[list[int], np.ndarray]]:
    """Models of one k together, a few at a time, with their centres stacked."""
    out = []
    for k in sorted({m.k for m in models}):
        mine = [i for i, m in enumerate(models) if m.k == k]
        for at in range(0, len(mine), STACK):
            some = mine[at : at + STACK]
            out.append((some, np.array([models[i].centres for i in some])))
    return out


def _sums(rows: DataFrame, models: Sequence[Model], spread: bool = False) -> list[np.ndarray]:
    """One pass: per model a table (clusters by size, cost, distances, squared norms, coordinate sums); none without rows.

    Distances (not squared) are added up if ``spread`` asks for them, else 0.
    """
    dims = len(models[0].centres[0])
    names = ["n", "spread", "norm", *[f"s{j}" for j in range(dims)]]
    weighted = any(m.rep is not None for m in models)
    columns = ["features", *["weights"] * weighted]
    shares = [(rep, some, _Sides(stacks)) for rep, some, stacks in _by_rep(models)]
    width = max(sides.columns for _, _, sides in shares)
    most = max(LEAST_BLOCK, min(MOST_BLOCK, CELLS // max(1, width)))

    def run(batches):
        total = [[np.zeros((*centres.shape[:2], len(names))) for centres in sides.stacks] for _, _, sides in shares]
        for x, *w in blocks(batches, *columns, most=most):
            times = np.ascontiguousarray(w[0].T) if weighted else None
            values = np.concatenate([np.ones((len(x), 1)), np.zeros((len(x), 1)), (x * x).sum(axis=1)[:, None], x], axis=1)
            for (rep, _, sides), out in zip(shares, total):
                if rep is None:
                    sides.add(x, values, values, out, spread)
                    continue
                drawn = np.flatnonzero(times[rep])  # rows that a resample leaves out add nothing
                mine = values[drawn]
                sides.add(x[drawn], mine, mine * times[rep, drawn][:, None], out, spread)
        model = np.concatenate([np.repeat(s, c.shape[1]) for _, some, sides in shares for s, c in zip(some, sides.stacks)])
        cluster = np.concatenate([np.tile(np.arange(c.shape[1]), len(c)) for _, _, sides in shares for c in sides.stacks])
        table = np.concatenate([t.reshape(-1, len(names)) for out in total for t in out])
        yield pa.RecordBatch.from_pydict(
            {"model": model.astype(np.int32), "cluster": cluster.astype(np.int32), **dict(zip(names, table.T.copy()))}
        )

    workers(rows.sparkSession)
    schema = "model int, cluster int, " + ", ".join(f"{c} double" for c in names)
    told = rows.select(*columns).mapInArrow(run, schema)
    told = told.groupBy("model", "cluster").agg(*[F.sum(c).alias(c) for c in names]).toPandas()
    if not len(told):
        return []
    told = told.sort_values(["model", "cluster"])
    table = told[names].to_numpy(float)
    # the squared distances of a cluster's rows to its centre follow from its sums
    centres = np.array([c for m in models for c in m.centres])
    n, norm, sums = table[:, 0], table[:, 2], table[:, 3:]
    cost = np.maximum(0.0, norm - 2 * (centres * sums).sum(axis=1) + n * (centres * centres).sum(axis=1))
    table = np.insert(table, 1, cost, axis=1)
    return np.split(table, np.cumsum([m.k for m in models])[:-1])


def _moved(model: Model, table: np.ndarray) -> Model:
    sums = table.tolist()
    new = tuple(
        tuple(round(s / line[0], DIGITS) + 0.0 for s in line[4:]) if line[0] else old for old, line in zip(model.centres, sums)
    )
    apart = sum((a - b) * (a - b) for old, fresh in zip(model.centres, new) for a, b in zip(old, fresh))
    return replace(model, centres=new, cost=sum(line[1] for line in sums), steps=model.steps + 1, still=apart <= STILL)


def advance(rows: DataFrame, models: Sequence[Model], steps: int = STEPS) -> list[Model]:
    """Models after at most ``steps`` Lloyd steps; those that stand still leave the passes."""
    models = list(models)
    for _ in range(steps):
        moving = [i for i, m in enumerate(models) if not m.still]
        if not moving:
            break
        sums = _sums(rows, [models[i] for i in moving])
        if not sums:  # no rows
            break
        for at, i in enumerate(moving):
            models[i] = _moved(models[i], sums[at])
    return models


def first_models(
    rows: DataFrame, ks: Sequence[int], starts: int, reps: Sequence[int | None] = (None,), id_col: str = "player_id", points: list | None = None
) -> list[Model]:
    """Models before their first step; ``points`` are start points already drawn, of as many starts or more."""
    points = start_points(rows, starts, max(ks), id_col) if points is None else points[:starts]
    return [Model(k, s, tuple(p[:k]), rep) for rep in reps for k in ks for s, p in enumerate(points)]


def best(models: Sequence[Model]) -> dict[tuple[int, int | None], Model]:
    """Per number of clusters and resample the model of least cost (to six places), of equal ones the first start."""
    out: dict[tuple[int, int | None], Model] = {}
    for m in sorted(models, key=lambda m: (round(m.cost, 6), m.start)):
        out.setdefault((m.k, m.rep), m)
    return out


def fit(rows: DataFrame, ks: Sequence[int], starts: int = 30, steps: int = STEPS, id_col: str = "player_id") -> dict[int, Model]:
    """The best model of each number of clusters over all starts."""
    return {k: m for (k, _), m in best(advance(rows, first_models(rows, ks, starts, id_col=id_col), steps)).items()}


def _squares(features: str, centre: Sequence[float]) -> Column:
    apart = F.zip_with(features, F.array(*[F.lit(float(v)) for v in centre]), lambda a, b: (a - b) * (a - b))
    return F.aggregate(apart, F.lit(0.0), lambda total, x: total + x)


def cluster_of(model: Model, features: str = "features") -> Column:
    """Number of the nearest centre."""
    apart = F.array(*[_squares(features, c) for c in model.centres])
    return (F.array_position(apart, F.array_min(apart)) - 1).cast("int")


def separations(rows: DataFrame, models: Sequence[Model]) -> list[dict]:
    """Calinski-Harabasz, Davies-Bouldin and squared silhouette of all models, in two passes over the rows.

    The silhouette of a row needs no pairs: a row's mean squared distance to a cluster follows from the cluster's size,
    sum and sum of squares. Rows of clusters of one have silhouette 0.
    """
    if not models:
        return []
    sums = _sums(rows, models, spread=True)
    dims = len(models[0].centres[0])
    tables = [t[:, [0, 3, *range(4, 4 + dims)]] for t in sums]

    def run(batches):
        total = np.zeros(len(models))
        for (x,) in blocks(batches, "features"):
            norm = (x * x).sum(axis=1)
            for i, (model, t) in enumerate(zip(models, tables)):
                label = nearest(x, np.array([model.centres]))[:, 0]
                size = t[:, 0]
                with np.errstate(divide="ignore", invalid="ignore"):
                    mean = norm[:, None] + t[:, 1] / size - 2 * (x @ t[:, 2:].T) / size
                    own = mean[np.arange(len(x)), label] * size[label] / (size[label] - 1)
                mean[:, size == 0] = np.inf
                mean[np.arange(len(x)), label] = np.inf
                other = mean.min(axis=1)
                alone = (size[label] <= 1) | ~np.isfinite(other)
                own = np.where(alone, 0.0, own)
                top = np.maximum(own, np.where(alone, 1.0, other))
                total[i] += np.where(alone | (top == 0), 0.0, (np.where(alone, 0.0, other) - own) / np.where(top == 0, 1.0, top)).sum()
        yield pa.RecordBatch.from_pydict({"model": np.arange(len(models), dtype=np.int32), "total": total})

    told = rows.select("features").mapInArrow(run, "model int, total double").groupBy("model").agg(F.sum("total").alias("total"))
    silhouettes = {r["model"]: r["total"] for r in told.collect()}
    out = []
    for i, model in enumerate(models):
        lines = [line for line in sums[i].tolist() if line[0]]
        n, k = sum(x[0] for x in lines), len(lines)
        points = [[s / x[0] for s in x[4:]] for x in lines]
        middle = [sum(x[4 + j] for x in lines) / n for j in range(dims)]
        between = sum(x[0] * math.dist(p, middle) ** 2 for x, p in zip(lines, points))
        within = sum(x[1] for x in lines)
        wide = [x[2] / x[0] for x in lines]
        worst = [
            max(((wide[a] + wide[b]) / (math.dist(points[a], points[b]) or 1e-12) for b in range(k) if b != a), default=0.0)
            for a in range(k)
        ]
        out.append(
            {
                "k": model.k,
                "silhouette": silhouettes[i] / n,
                "calinski": (between / (k - 1)) / (within / (n - k)) if 1 < k < n and within else math.nan,
                "davies_bouldin": sum(worst) / k,
                "cost": within,
            }
        )
    return out


def contingencies(rows: DataFrame, base: Model, refits: Sequence[Model]) -> DataFrame:
    """(rep, k, a, b, n): how often base label a meets refit label b, with the weights of the refit's resample."""
    schema = "rep int, k int, a int, b int, n double"
    groups = _groups(refits)
    reps = [[refits[i].rep for i in some] for some, _ in groups]
    centre = np.array([base.centres])

    def run(batches):
        total = [np.zeros((*centres.shape[:2], base.k)) for _, centres in groups]
        for x, w in blocks(batches, "features", "weights"):
            first = (nearest(x, centre) == np.arange(base.k)).astype(float)
            for (_, centres), rep, out in zip(groups, reps, total):
                label, times = nearest(x, centres), w[:, rep]
                for b in range(centres.shape[1]):
                    out[:, b] += ((label == b) * times).T @ first
        cells = [(r, base.k, a, b, n) for rep, t in zip(reps, total) for r, one in zip(rep, t) for (b, a), n in np.ndenumerate(one) if n]
        kinds = {"rep": np.int32, "k": np.int32, "a": np.int32, "b": np.int32, "n": float}
        yield pa.RecordBatch.from_pydict({c: np.array([x[i] for x in cells], t) for i, (c, t) in enumerate(kinds.items())})

    told = rows.select("features", "weights").mapInArrow(run, schema)
    return told.groupBy("rep", "k", "a", "b").agg(F.sum("n").alias("n"))


def rand_index(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Adjusted Rand index of tables of counts (a, b, n), one per value of ``by``."""
    pairs = C("n") * (C("n") - 1) / 2
    parts = [
        cells.groupBy(*by, *side).agg(F.sum("n").alias("n")).groupBy(*by).agg(F.sum(pairs).alias(name))
        for side, name in ((["a", "b"], "same"), (["a"], "first"), (["b"], "second"), ([], "all"))
    ]
    table = parts[0]
    for part in parts[1:]:
        table = table.join(part, list(by))
    chance = C("first") * C("second") / C("all")
    top = (C("first") + C("second")) / 2
    return table.select(*by, F.when(top == chance, 1.0).otherwise((C("same") - chance) / (top - chance)).alias("ari"))


def bootstrap(
    rows: DataFrame, ks: Sequence[int], reps: int = 80, starts: int = 20, refit_starts: int = 10, share: float = 0.8, id_col: str = "player_id"
) -> DataFrame:
    """(k, rep, ari): agreement of the fit on all rows with the best refit on each resample, on its rows.

    All refits of all resamples advance in the same passes.
    """
    rows = rows.select(id_col, "features")
    points = start_points(rows, max(starts, refit_starts), max(ks), id_col)
    drawn = settle(with_weights(rows, reps, share, id_col).select("features", "weights"), "resamples")
    bases = {k: m for (k, _), m in best(advance(drawn, first_models(drawn, ks, starts, points=points))).items()}
    refits = best(advance(drawn, first_models(drawn, ks, refit_starts, range(reps), points=points)))
    cells = None
    for k, base in sorted(bases.items()):
        part = contingencies(drawn, base, [m for (n, _), m in sorted(refits.items()) if n == k])
        cells = part if cells is None else cells.unionByName(part)
    return rand_index(settle(cells, "contingencies"), ["k", "rep"])
