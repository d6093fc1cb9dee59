"""K-means of many starts, mixtures, components, hierarchies and label tables against plain versions."""

import hashlib
import itertools
import math
import os
import random
import subprocess
import sys

import numpy as np
import pytest

from poolgrade.operators import clusters, components, lloyd, mixtures


def blobs(spark, n=240, dims=3, seed=1, groups=3):
    draw = random.Random(seed)
    middles = [[draw.uniform(-6, 6) for _ in range(dims)] for _ in range(groups)]
    rows = [(f"p{i:04d}", [round(draw.gauss(m, 1.0), 4) for m in middles[i % groups]], str(i % groups)) for i in range(n)]
    return spark.createDataFrame(rows, "player_id string, features array<double>, atual string").repartition(3), rows


def drawn(rows, start, slot):
    def key(row):
        digest = hashlib.md5(f"{start}:{row[0]}".encode()).hexdigest()
        return digest[lloyd.DRAW_HEX * slot : lloyd.DRAW_HEX * (slot + 1)], row[0]

    return min(rows, key=key)[1]


def plain_kmeans(rows, k, start, weight=lambda row: 1):
    centres = [drawn(rows, start, j) for j in range(k)]
    for step in range(1, lloyd.STEPS + 1):
        groups, cost = [[] for _ in centres], 0.0
        for row in rows:
            apart = [sum((a - b) * (a - b) for a, b in zip(row[1], c)) for c in centres]
            at = apart.index(min(apart))
            groups[at] += [row[1]] * weight(row)
            cost += min(apart) * weight(row)
        new = [[round(sum(x) / len(g), 9) for x in zip(*g)] if g else c for g, c in zip(groups, centres)]
        moved = sum((a - b) ** 2 for x, y in zip(centres, new) for a, b in zip(x, y))
        centres = new
        if moved <= lloyd.STILL:
            break
    return centres, cost, step


def test_all_models_in_one_pass_are_the_plain_ones(spark, monkeypatch):
    monkeypatch.setattr(lloyd, "STACK", 4)
    monkeypatch.setattr(lloyd, "BLOCK", 50)
    df, rows = blobs(spark)
    for model in lloyd.advance(df, lloyd.first_models(df, (2, 3, 5), 4)):
        centres, cost, steps = plain_kmeans(rows, model.k, model.start)
        assert model.steps == steps and abs(model.cost - cost) < 1e-6
        assert np.allclose(model.centres, centres, atol=1e-8)


def test_passes_do_not_grow_with_the_models(spark, monkeypatch):
    df, _ = blobs(spark)
    passes = []
    count = lloyd._sums
    monkeypatch.setattr(lloyd, "_sums", lambda rows, models: passes.append(len(models)) or count(rows, models))
    models = lloyd.advance(df, lloyd.first_models(df, (2, 3, 4, 5, 6), 6))
    assert len(passes) == max(m.steps for m in models) < len(models)


def test_weights_are_resamples(spark):
    df, rows = blobs(spark, n=90)
    heavy = lloyd.with_weights(df, 5, 0.8)
    weights = {r["player_id"]: r["weights"] for r in heavy.collect()}
    assert 0.6 < sum(map(sum, weights.values())) / (5 * 90) < 1.0
    models = lloyd.advance(heavy, lloyd.first_models(heavy, (2,), 1, range(5)))
    for model in models:
        centres, cost, _ = plain_kmeans(rows, 2, 0, lambda row: int(weights[row[0]][model.rep]))
        assert abs(model.cost - cost) < 1e-6 and np.allclose(model.centres, centres, atol=1e-8)
    told = lloyd.bootstrap(df, (3,), 4, 5, 5).collect()
    assert len(told) == 4 and all(r["ari"] > 0.8 for r in told)  # three clear groups are stable


def test_separations_against_all_pairs(spark):
    df, rows = blobs(spark, n=60)
    fits = lloyd.fit(df, (2, 3), 5)
    for told, model in zip(lloyd.separations(df, [fits[2], fits[3]]), (fits[2], fits[3])):
        x = np.array([r[1] for r in rows])
        label = ((x[:, None] - np.array(model.centres)) ** 2).sum(axis=2).argmin(axis=1)
        far = ((x[:, None] - x[None]) ** 2).sum(axis=2)
        shapes = []
        for i in range(len(x)):
            mine = label == label[i]
            a = far[i, mine].sum() / max(mine.sum() - 1, 1)
            b = min(far[i, label == c].mean() for c in set(label) - {label[i]})
            shapes.append((b - a) / max(a, b) if mine.sum() > 1 else 0.0)
        assert abs(told["silhouette"] - np.mean(shapes)) < 1e-6


def test_no_rows_no_models(spark):
    df, _ = blobs(spark)
    none = df.where("false")
    assert lloyd.fit(none, (2, 3), 3) == {} and mixtures.fit(none, (2,), 2) == {}
    assert clusters.bisected(none, 3, 2)[1] == []
    assert clusters.k_selection(none, "atual", (2, 3), 2) == []


def test_repeated_rows_and_fewer_rows_than_clusters(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0])] * 3 + [("b", [4.0, 2.0])], "player_id string, features array<double>")
    model = lloyd.fit(df, (4,), 6)[4]
    assert model.cost == 0.0
    assert {r[0] for r in df.select(lloyd.cluster_of(model)).collect()} <= {0, 1, 2, 3}


def test_likelihood_never_falls_and_memberships_add_up(spark):
    df, rows = blobs(spark, n=300)
    models = mixtures.of_clusters(df, lloyd.advance(df, lloyd.first_models(df, (2, 3), 3)))
    for _ in range(8):
        models = mixtures.step(df, models)
    for m in models:
        assert all(b >= a - 1e-9 for a, b in itertools.pairwise(m.trace))
    best = mixtures.fit(df, (3,), 3)[3]
    told = mixtures.with_memberships(df, best).collect()
    total = 0.0
    for r in told:
        x = np.array(r["features"])
        dense = []
        for w, m, c in zip(best.weights, best.means, best.covariances):
            z = x - m
            dense.append(w * math.exp(-0.5 * z @ np.linalg.solve(c, z)) / math.sqrt(np.linalg.det(2 * math.pi * c)))
        assert np.allclose(r["membership"], np.array(dense) / sum(dense), atol=1e-9)
        assert r["component"] == int(np.argmax(dense)) and abs(r["log_density"] - math.log(sum(dense))) < 1e-7
        total += r["log_density"]
    assert abs(mixtures.step(df, [best])[0].likelihood - total) < 1e-6
    groups = {}
    for r in told:
        groups.setdefault(r["atual"], []).append(r["component"])
    main = {g: max(set(c), key=c.count) for g, c in groups.items()}
    assert len(set(main.values())) == 3 and all(c.count(main[g]) >= 95 for g, c in groups.items())  # clear groups are found


def test_components_solve_the_problem(spark):
    df, rows = blobs(spark, dims=4)
    found = components.principal(df, 4)
    told = found.certificate()
    x = np.array([r[1] for r in rows])
    assert told["residual"] < 1e-9 and told["apart"] < 1e-9
    assert abs(told["trace"] - np.cov(x.T).trace()) < 1e-9
    scores = np.array([r[0:4] for r in components.with_scores(df, found, 4).select("pc1", "pc2", "pc3", "pc4").collect()])
    assert np.allclose(np.cov(scores.T), np.diag(found.variances), atol=1e-8)
    assert all(line[np.abs(line).argmax()] > 0 for line in found.loadings)


def test_hierarchy_telescopes(spark):
    df, rows = blobs(spark)
    leaves, tree = clusters.bisected(df, 4, 5)
    sizes = {r["node"]: r["count"] for r in leaves.groupBy("node").count().collect()}
    ends = {t["node"]: t for t in tree if t["removed"] is None}
    assert {n: t["size"] for n, t in ends.items()} == sizes and sum(sizes.values()) == len(rows)
    removed = sum(t["removed"] for t in tree if t["removed"] is not None)
    assert abs(tree[0]["scatter"] - removed - sum(t["scatter"] for t in ends.values())) < 1e-6


@pytest.mark.parametrize("seed", range(3))
def test_unique_labels_by_hand(spark, seed):
    draw = random.Random(seed)
    labels = ["x", "y", "z"]
    rows = [(g, c, *[float(draw.randrange(4)) for _ in labels]) for g in "ab" for c in range(draw.choice([1, 2, 3, 5]))]
    df = spark.createDataFrame(rows, "g string, cluster int, x double, y double, z double").repartition(4)
    want, loud = {}, {}
    for g in "ab":
        mine = [r for r in rows if r[0] == g]
        free = {r[1]: r for r in mine}
        for i, label in enumerate(labels):
            if free:
                at = max(free, key=lambda c: (free[c][2 + i], -c))
                want[g, at] = label
                del free[at]
        want |= {(g, c): "rest" for c in free}
        loud |= {(g, r[1]): labels[max(range(3), key=lambda i: (r[2 + i], -i))] for r in mine}
    assert {(r["g"], r["cluster"]): r["label"] for r in clusters.unique_labels(df, labels, "rest", ["g"]).collect()} == want
    assert {(r["g"], r["cluster"]): r["label"] for r in clusters.dominant_labels(df, labels, ["g"]).collect()} == loud


def test_a_session_without_a_shared_folder_settles_and_releases(tmp_path):
    code = """
from poolgrade.session import local_session, release, settle
spark = local_session("2", 2, "1g")
assert spark.conf.get("spark.checkpoint.dir", None) is None
assert settle(spark.range(5)).count() == 5
assert release(spark)
spark.stop()
"""
    (tmp_path / "conf").mkdir()
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path / "conf"), "PYTHONPATH": root}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert done.returncode == 0, done.stderr[-2000:]
