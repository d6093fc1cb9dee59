"""Clustering studies on pool features, and how label columns agree."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.scalar import row_mean
from ..session import settle, settle_measured
from . import lloyd, mixtures
from .pools import min_max

C = F.col
STARTS = 30

# ------------------------------------------------------------------------------- features


def scaled_features(df: DataFrame, columns: Sequence[str], out: str = "features") -> tuple[DataFrame, dict]:
    """Settled frame with an array of population-scaled columns (nulls count as 0), and their means and deviations.

    Only two numbers per column reach the driver. Values are rounded, so later sums do not hang on task order.
    """
    values = [F.coalesce(C(c).cast("double"), F.lit(0.0)) for c in columns]
    stats = df.agg(
        *[e.alias(f"{k}_{i}") for i, v in enumerate(values) for k, e in (("m", F.avg(v)), ("s", F.stddev_pop(v)))]
    ).first()
    scale = {c: (stats[f"m_{i}"] or 0.0, stats[f"s_{i}"] or 1.0) for i, c in enumerate(columns)}
    scaled = [F.round((v - F.lit(scale[c][0])) / F.lit(scale[c][1]), lloyd.DIGITS) for v, c in zip(values, columns)]
    return settle(df.withColumn(out, F.array(*scaled)), "features"), scale


def unscale(centre: Sequence[float], columns: Sequence[str], scale: Mapping[str, tuple[float, float]]) -> dict[str, float]:
    return {c: float(v) * scale[c][1] + scale[c][0] for c, v in zip(columns, centre)}


# ------------------------------------------------------------------------------ hierarchy


def bisected(rows: DataFrame, leaves: int, starts: int = STARTS, id_col: str = "player_id") -> tuple[DataFrame, list[dict]]:
    """Top-down hierarchy: the leaf of greatest scatter is cut in two by the best of many 2-means, until enough leaves.

    Returns the rows with their leaf's ``node`` and the tree: node, parent, size, scatter, removed (by cutting the
    node; null for leaves) and centre. Node 0 is the pool; a leaf that cannot be cut stays.
    """
    one = lloyd.best(lloyd.advance(rows, lloyd.first_models(rows, (1,), 1, id_col=id_col)))
    if not one or one[1, None].cost == math.inf:
        return rows.withColumn("node", F.lit(0)), []
    root = one[1, None]
    tree = [{"node": 0, "parent": None, "size": rows.count(), "scatter": root.cost, "removed": None, "centre": root.centres[0]}]
    out, stuck = rows.withColumn("node", F.lit(0)), set()
    while sum(t["removed"] is None for t in tree) < leaves:
        free = [t for t in tree if t["removed"] is None and t["node"] not in stuck]
        if not free:
            break
        leaf = max(free, key=lambda t: (round(t["scatter"], 6), -t["node"]))
        model = lloyd.fit(out.where(C("node") == leaf["node"]), (2,), starts, id_col=id_col)[2]
        first = max(t["node"] for t in tree) + 1
        side = lloyd.cluster_of(model)
        sizes = {f"n{i}": F.count_if(C("node") == first + i) for i in (0, 1)}
        costs = {
            f"c{i}": F.sum(F.when(C("node") == first + i, lloyd._squares("features", c)).otherwise(0.0))
            for i, c in enumerate(model.centres)
        }
        cut, told = settle_measured(
            out.withColumn("node", F.when(C("node") == leaf["node"], F.lit(first) + side).otherwise(C("node"))), "nodes", sizes | costs
        )
        if not told["n0"] or not told["n1"]:
            stuck.add(leaf["node"])
            continue
        out = cut
        leaf["removed"] = leaf["scatter"] - told["c0"] - told["c1"]
        tree += [
            {"node": first + i, "parent": leaf["node"], "size": told[f"n{i}"], "scatter": told[f"c{i}"], "removed": None, "centre": c}
            for i, c in enumerate(model.centres)
        ]
    return out, tree


# ----------------------------------------------------------------------------- diagnostics


def label_agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement percent, adjusted Rand index and normalised mutual information, from counts only."""
    cells = df.groupBy(C(a).cast("string").alias("a"), C(b).cast("string").alias("b")).agg(
        F.count(F.lit(1)).cast("double").alias("n")
    )
    cells = settle(cells, "contingency")
    pairs = C("n") * (C("n") - 1) / 2
    rows = cells.groupBy("a").agg(F.sum("n").alias("n"))
    cols = cells.groupBy("b").agg(F.sum("n").alias("n"))
    entropy = -F.sum(C("n") / C("t") * F.log(C("n") / C("t")))
    whole = cells.agg(
        F.sum("n").alias("t"), F.sum(pairs).alias("same"), F.sum(F.when(C("a") == C("b"), C("n")).otherwise(0)).alias("agree")
    )

    size = whole.select("t").scalar()

    def against_total(side: DataFrame, name: str) -> DataFrame:
        return side.withColumn("t", size).agg(F.sum(pairs).alias(f"pairs_{name}"), entropy.alias(f"h_{name}"))

    joint = cells.withColumn("t", size).agg(entropy.alias("h_joint"))
    one = F.lit(1).alias("_one")
    table = whole.select("*", one)
    for part in (against_total(rows, "a"), against_total(cols, "b"), joint):
        table = table.join(part.select("*", one), "_one")
    chance = C("pairs_a") * C("pairs_b") / (C("t") * (C("t") - 1) / 2)
    top = (C("pairs_a") + C("pairs_b")) / 2
    mutual = C("h_a") + C("h_b") - C("h_joint")
    mean_h = (C("h_a") + C("h_b")) / 2
    return table.select(
        (C("agree") / C("t") * 100).alias("agree_pct"),
        F.when(top == chance, 1.0).otherwise((C("same") - chance) / (top - chance)).alias("ari"),
        F.when(mean_h == 0, 1.0).otherwise(mutual / mean_h).alias("nmi"),
    )


def k_selection(
    df: DataFrame, label: str, ks: Sequence[int] = (2, 3, 4, 5, 6), starts: int = STARTS, id_col: str = "player_id"
) -> list[dict]:
    """Figures of the best K-means of each K, with the best K by each of them; ties go to the smaller K."""
    fits = lloyd.fit(df, ks, starts, id_col=id_col)
    models = [fits[k] for k in sorted(fits)]
    out = lloyd.separations(df, models)
    for row, model in zip(out, models):
        labelled = df.withColumn("cluster", lloyd.cluster_of(model))
        row["ari"] = label_agreement(labelled, label, "cluster").first()["ari"]
    for figure, sign in (("silhouette", -1), ("calinski", -1), ("davies_bouldin", 1)):
        chosen = min(out, key=lambda x: (sign * round(x[figure], 6), x["k"]), default=None)
        for row in out:
            row[f"best_{figure}"] = row is chosen
    return out


# -------------------------------------------------------------------- labels for clusters


def unique_labels(centroids: DataFrame, labels: Sequence[str], rest: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, cluster, label): each label in turn takes the free cluster of greatest score, of equal ones the lowest.

    ``centroids`` has ``cluster`` and a score column per label; there are few clusters. Clusters left over get ``rest``.
    """
    numbered = centroids.withColumn("cluster", C("cluster").cast("int"))
    told = numbered.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("cluster", *labels))).alias("_cells"))
    told = told.withColumn("_taken", F.array().cast("array<int>"))
    for label in labels:
        free = F.filter("_cells", lambda x: ~F.array_contains("_taken", x["cluster"]))
        told = told.withColumn("_best", F.array_max(F.transform(free, _ranked(label)))["c"])
        told = told.withColumn("_taken", F.when(C("_best").isNull(), C("_taken")).otherwise(F.array_append("_taken", -C("_best"))))
    names = F.array(*[F.lit(x) for x in labels])
    told = told.select(*by, F.explode("_cells").alias("x"), "_taken").select(*by, C("x")["cluster"].alias("cluster"), "_taken")
    place = F.array_position("_taken", C("cluster"))
    return told.select(*by, "cluster", F.when(place > 0, F.get(names, (place - 1).cast("int"))).otherwise(F.lit(rest)).alias("label"))


def _ranked(label: str):
    return lambda x: F.struct(x[label].alias("v"), (-x["cluster"]).alias("c"))


def dominant_labels(centroids: DataFrame, labels: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, cluster, label): the label of greatest score, of equal ones the first named; labels may repeat."""
    peak = F.greatest(*[C(x) for x in labels])
    label = F.coalesce(*[F.when(C(x) == peak, F.lit(x)) for x in labels])
    return centroids.select(*by, C("cluster").cast("int").alias("cluster"), label.alias("label"))


def centroid_scores(spark, centres: Sequence[Mapping[str, float]], goals: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """A centroid table for the two functions above: a weighted score per label."""
    rows = [(i, *[float(sum(w * c[f] for f, w in terms.items())) for terms in goals.values()]) for i, c in enumerate(centres)]
    return spark.createDataFrame(rows, "cluster int, " + ", ".join(f"`{g}` double" for g in goals))


def named(df: DataFrame, names: DataFrame, out: str, cluster: str = "cluster") -> DataFrame:
    """``df`` with the label of its cluster as ``out``, instead of a column of that name; ``names`` has one row per cluster."""
    df = df.drop(out)
    names = names.select(C("cluster").alias("_c"), C("label").alias(out))
    return df.join(F.broadcast(names), C(cluster) == C("_c"), "left").drop("_c")


def scaled_centres(centres: Sequence[Mapping[str, float]], columns: Sequence[str]) -> list[dict[str, float]]:
    """Centres scaled against each other, column by column."""
    out = [dict() for _ in centres]
    for c in columns:
        values = [x[c] for x in centres]
        mean = sum(values) / len(values)
        sd = math.sqrt(sum((v - mean) ** 2 for v in values) / len(values)) or 1.0
        for row, v in zip(out, values):
            row[c] = (v - mean) / sd
    return out


def confusion(df: DataFrame, a: str, b: str, labels: Sequence[str]) -> DataFrame:
    """(a, b, n) for every pair of the labels, also where no row has it."""
    spark = df.sparkSession
    cells = spark.createDataFrame([(x, y) for x in labels for y in labels], "a string, b string")
    found = df.groupBy(C(a).alias("a"), C(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return cells.join(found, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("n"))


# Which centroid figures speak for which label.
RAW_GOALS = {
    "Construtor": {"passes_prog": 1 / 3, "passes_long": 1 / 3, "passes_final": 1 / 3},
    "Combativo": {"duels_def": 1.0, "clearances_raw": 0.5},
    "Posicional": {"interceptions_raw": 1.0, "duels_air": 1.0, "shots_blocked": 1.0},
}
COMPOSITE_FEATURES = ("prog_done", "long_done", "final_done", "duel_efficiency", "reading_index", "carry_prog")
COMPOSITE_GOALS = {
    "Construtor": {"prog_done": 1 / 3, "long_done": 1 / 3, "final_done": 1 / 3},
    "Posicional": {"reading_index": 1.0, "final_done": 0.3},
    "Combativo": {"duel_efficiency": 0.65, "carry_prog": 0.35},
}
AXIS_GOALS = {
    "Combativo": {"blk_duelos_def": 1.0},
    "Construtor": {"blk_construcao": 1.0, "blk_conducao": 1.0},
    "Posicional": {"blk_leitura": 1.0, "blk_duelo_ar": 1.0},
}


def mixture_labels(df: DataFrame, model: mixtures.Mixture, names: DataFrame, certain: float = 0.45) -> DataFrame:
    """Component label, hybrid when no membership is clear, with confidence and entropy."""
    scored = mixtures.with_memberships(df, model).withColumnRenamed("component", "_cluster")
    scored = named(scored, names, "component", "_cluster")
    return scored.withColumn("gmm_label", F.when(C("confidence") < certain, config.HYBRID).otherwise(C("component"))).drop("_cluster")


def quadrant_labels(x: Column, y: Column, margin: float) -> Column:
    """Four corners of two components; the middle is hybrid."""
    return (
        F.when((x > margin) & (y < -margin), "Construtor")
        .when((x < -margin) & (y > margin), "Combativo")
        .when((x > margin) & (y > margin), "Posicional")
        .otherwise(config.HYBRID)
    )


def raw_quadrant_labels(x: Column, y: Column) -> Column:
    """The corners used for the eleven raw features."""
    return (
        F.when((x > 0.4) & (y < -0.2), "Construtor")
        .when((x < -0.2) & (y > 0.4), "Combativo")
        .when((x > 0.3) & (y > 0.3), "Posicional")
        .otherwise(config.HYBRID)
    )


AXIS_BUILD = ("passes_prog", "passes_long", "passes_final", "runs_prog")
AXIS_DEFEND = ("duels_def", "duels_air", "interception_won_p90")


def with_two_axes(df: DataFrame) -> DataFrame:
    """``score_con`` and ``score_def``: means of measures scaled to 0..1 inside the pool."""
    unit = min_max(df, ["family"], {f"_u_{c}": c for c in (*AXIS_BUILD, *AXIS_DEFEND)})
    return unit.withColumns(
        {
            "score_con": row_mean([C(f"_u_{c}") for c in AXIS_BUILD]),
            "score_def": row_mean([C(f"_u_{c}") for c in AXIS_DEFEND]),
        }
    ).drop(*[f"_u_{c}" for c in (*AXIS_BUILD, *AXIS_DEFEND)])


def two_axis_labels(centres: DataFrame) -> DataFrame:
    """(cluster, label) of centroids with ``score_con`` and ``score_def``: the smallest gap is the hybrid, of the others the
    strongest builder is the builder, the rest defend. Of equal ones the lowest cluster counts first. There are few clusters.
    """
    gap = F.abs(C("score_con") - C("score_def"))
    cells = centres.select(F.sort_array(F.collect_list(F.struct(gap.alias("gap"), "cluster", "score_con"))).alias("x"))
    others = F.sort_array(F.transform(F.slice("x", 2, F.size("x")), lambda c: F.struct((-c["score_con"]).alias("o"), c["cluster"].alias("cluster"))))
    cells = cells.select(C("x")[0]["cluster"].alias("hybrid"), others.alias("y"))
    cells = cells.select("hybrid", F.explode_outer(F.concat(F.array(C("hybrid")), F.transform("y", lambda c: c["cluster"]))).alias("cluster"), F.get("y", 0)["cluster"].alias("first"))
    label = F.when(C("cluster") == C("hybrid"), config.HYBRID).when(C("cluster") == C("first"), "Construtor").otherwise("Defensivo")
    return cells.where(C("cluster").isNotNull()).select("cluster", label.alias("label"))


def with_two_axis_profile(df: DataFrame, starts: int = STARTS) -> DataFrame:
    """Construction and defence scores, three clusters of them, and the lean of the hybrids."""
    axes = ["score_con", "score_def"]
    ready, scale = scaled_features(with_two_axes(df), axes)
    model = lloyd.fit(ready, (3,), starts).get(3) or lloyd.Model(3, 0, ((0.0, 0.0),) * 3)  # an empty pool has no centres
    centres = [(i, *unscale(c, axes, scale).values()) for i, c in enumerate(model.centres)]
    names = two_axis_labels(df.sparkSession.createDataFrame(centres, "cluster int, score_con double, score_def double"))
    labelled = named(ready.withColumn("cluster", lloyd.cluster_of(model)), names, "perfil_k3")
    lean = F.when(C("score_con") >= C("score_def"), "+ Construtor").otherwise("+ Defensivo")
    return labelled.withColumn("hybrid_lean", F.when(C("perfil_k3") == config.HYBRID, lean)).drop("features", "cluster")
