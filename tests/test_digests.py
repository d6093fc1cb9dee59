"""Draws of starts and resamples by many digests at once, and K-means sums that leave out what a resample does not draw."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from poolgrade.catalog import clusters, load
from poolgrade.operators import digests, lloyd


def test_digests_are_those_of_hashlib():
    texts = [f"red-bolt-{i}" for i in range(300)] + ["", "é" * 9, *("x" * n for n in (50, 52, 53, 54, 55, 56, 64, 300)), None]
    laid = digests.Texts(pa.array(texts))
    assert laid.null.tolist() == [t is None for t in texts]
    for prefix in (b"0:", b"1234:"):
        words = laid.md5(prefix)
        want = [hashlib.md5(prefix + (t or "").encode()).hexdigest() for t in texts]
        assert ["".join(f"{w:08x}" for w in words[:, i]) for i in range(len(texts))] == want
        for start, count in ((0, 8), (5, 5), (25, 5), (30, 5), (35, 5)):
            assert digests.digits(words, start, count).tolist() == [int(h[start : start + count] or "0", 16) for h in want]


def test_starts_are_the_least_digest_then_the_least_id(spark):
    rows = [(f"p{i % 50}", [float(i % 50), 1.0]) for i in range(100)]
    df = spark.createDataFrame(rows, "player_id string, features array<double>").repartition(5)
    for start, points in enumerate(lloyd.start_points(df, 3, 7)):
        for j, point in enumerate(points):
            part = slice(lloyd.DRAW_HEX * j, lloyd.DRAW_HEX * (j + 1))
            want = min(rows, key=lambda r: (hashlib.md5(f"{start}:{r[0]}".encode()).hexdigest()[part], r[0]))
            assert point == tuple(want[1])
    nameless = df.union(spark.createDataFrame([(None, [-1.0, -1.0])], df.schema))
    assert lloyd.start_points(nameless, 2, 2) == [[(-1.0, -1.0)] * 2] * 2  # nulls come first
    assert [r["weights"] for r in lloyd.with_weights(nameless, 4).where("player_id IS NULL").collect()] == [bytes(4)]
    plan = lloyd.with_weights(df, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "md5" not in plan


def test_sums_of_models_with_repeated_centres_and_ties(spark):
    draw = np.random.default_rng(5)
    x = np.round(draw.normal(size=(700, 3)), 9)
    times = draw.poisson(0.8, size=(700, 2))
    df = spark.createDataFrame(
        [(x[i].tolist(), bytes(times[i].tolist())) for i in range(700)], "features array<double>, weights binary"
    ).repartition(3)
    models = []
    for rep in (0, 1):
        for k in (1, 2, 3, 4):
            centres = np.round(draw.normal(size=(k, 3)), 9)
            if k > 2:
                centres[2] = centres[1]
                centres[0] = 2 * x[0] - centres[1]  # as far from the first row
            models.append(lloyd.Model(k, 0, tuple(map(tuple, centres.tolist())), rep))
    for model, table in zip(models, lloyd._sums(df, models)):
        label = lloyd._distances(x, np.array([model.centres])).argmin(axis=2)[:, 0]
        for c in range(model.k):
            w = times[:, model.rep] * (label == c)
            assert np.allclose(table[c][[0, 3, 4, 5, 6]], [w.sum(), w @ (x * x).sum(axis=1), *(w @ x)], atol=1e-9)


def test_resamples_write_the_features_alone(spark, monkeypatch):
    seen = []
    made = {c: F.lit("p" if c in ("player_id", "family") else 1.0).alias(c) for c in ("player_id", "family", *clusters.RAW, "xa", "label")}
    monkeypatch.setattr(clusters, "pool", lambda *_: spark.range(3).select(*made.values()))
    monkeypatch.setattr(clusters, "settle", lambda df, name="stage": seen.append(df.columns) or df)
    monkeypatch.setattr(lloyd, "bootstrap", lambda rows, *_: (_ for _ in ()).throw(LookupError(rows.columns)))
    try:
        load()["m9_bootstrap_stability"].run(spark, "")
    except LookupError as found:
        assert found.args[0] == ["player_id", "features"]
    assert seen == [["player_id", *clusters.RAW]]
