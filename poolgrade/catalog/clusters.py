"""Clustering studies. K-means runs to its end in SQL too; mixtures and components are checked through what they imply."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config
from ..functions import labels
from ..operators import clusters as k
from ..operators import components, lloyd, mixtures
from ..plans.centrebacks import final_archetype, with_archetype_axes
from ..plans.families import with_blocks
from ..session import settle
from ..sources.tables import table
from . import model_sql as ms
from . import query
from .backs import AXIS_CTES
from .base import PLACES, pool, r, tidy, with_base
from .search import LABEL_SQL, labelled

C = F.col
RAW = (
    "duels_def", "duels_air", "shots_blocked", "interceptions_raw", "clearances_raw", "fouls",
    "duels_off", "runs_prog", "passes_long", "passes_final", "passes_prog",
)
KS = (2, 3, 4, 5, 6)
STARTS, MIXTURE_STARTS, OPTION_STARTS = 30, 10, 15
RESAMPLES, RESAMPLED_KS, RESAMPLED_STARTS, REFIT_STARTS = 80, (2, 3, 4), 20, 10
MARGINS = (0.25, 0.35, 0.45)
# What the mixture's groups are called, and the order of labels in tables.
OPTION_NAMES = {"Construtor": "Construtor", "Posicional": "Leitura", "Combativo": "Duelista", "Híbrido": "Híbrido"}
ORDER = ("Construtor", "Posicional", "Combativo", "Híbrido")
FEATURES = [*AXIS_CTES, *ms.feature_ctes("arch", RAW, "player_id, archetype")]


def study_sql(*ctes, select):
    return ms.recursive(with_base(*FEATURES, *ctes, select=select))


def study_pool(spark, folder):
    """The whole pool with its archetype as the current label."""
    people = with_archetype_axes(pool(spark, folder))
    return settle(people.withColumn("atual", final_archetype()), "study")


@query(
    "m8_label_agreement",
    "M8",
    f"""WITH {LABEL_SQL}, cell AS (SELECT a, b, count(*)::DOUBLE AS n FROM lab GROUP BY a, b), ra AS (SELECT a, sum(n) AS n FROM cell GROUP BY a),
     rb AS (SELECT b, sum(n) AS n FROM cell GROUP BY b), t AS (SELECT sum(n) AS t FROM cell),
     v AS (SELECT (SELECT t FROM t) AS t, (SELECT sum(n * (n - 1) / 2) FROM cell) AS same, (SELECT sum(n * (n - 1) / 2) FROM ra) AS pa, (SELECT sum(n * (n - 1) / 2) FROM rb) AS pb,
       (SELECT sum(n) FILTER (a = b) FROM cell) AS agree, (SELECT -sum(n / t * ln(n / t)) FROM ra, t) AS ha, (SELECT -sum(n / t * ln(n / t)) FROM rb, t) AS hb, (SELECT -sum(n / t * ln(n / t)) FROM cell, t) AS hj)
     SELECT {r("agree / t * 100", "agree_pct")}, {r("(same - pa * pb / (t * (t - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (t * (t - 1) / 2))", "ari")}, {r("(ha + hb - hj) / ((ha + hb) / 2)", "nmi")} FROM v""",
)
def _(spark, folder):
    return tidy(k.label_agreement(labelled(spark, folder), "a", "b"))


def _unit(column: str) -> str:
    low, high = (f"{fn}({column}) OVER (PARTITION BY family)" for fn in ("min", "max"))
    return f"(CASE WHEN {high} <= {low} THEN 0e0 ELSE ({column} - {low}) / ({high} - {low}) END)"


def _mean(columns) -> str:
    return "(" + " + ".join(map(_unit, columns)) + f") / {len(columns)}e0"


@query(
    "c9_axis_scores",
    "C9",
    with_base(
        f"axes AS (SELECT player_id, family, {_mean(k.AXIS_BUILD)} AS con, {_mean(k.AXIS_DEFEND)} AS def FROM pool)",
        select=f"SELECT player_id, {r('con', 'score_con')}, {r('def', 'score_def')} FROM axes WHERE family = 'zagueiros'",
    ),
)
def _(spark, folder):
    out = k.with_two_axes(pool(spark, folder).where(C("family") == "zagueiros"))
    return tidy(out, "player_id", "score_con", "score_def")


def _two_axis_sql() -> str:
    scores = f"axes AS (SELECT player_id, {_mean(k.AXIS_BUILD)} AS con, {_mean(k.AXIS_DEFEND)} AS def FROM pool WHERE family = 'zagueiros')"
    centre = "gaps AS (SELECT c - 1 AS cluster, centres[c][1] * s0 + m0 AS con, centres[c][2] * s1 + m1 AS def FROM chosen, feat_scale, range(1, 4) t(c))"
    hybrid = "mid AS (SELECT arg_min(cluster, {'g': abs(con - def), 'c': cluster}) AS h FROM gaps)"
    builder = "top AS (SELECT arg_min(cluster, {'o': -con, 'c': cluster}) AS b FROM gaps, mid WHERE cluster <> h)"
    label = "CASE WHEN cluster = h THEN 'Híbrido' WHEN cluster = b THEN 'Construtor' ELSE 'Defensivo' END"
    return ms.recursive(
        with_base(
            scores, *ms.feature_ctes("axes", ("con", "def"), "player_id, con, def"), *ms.lloyd_ctes((3,), STARTS, 2),
            ms.labelled_cte(2, "labelled"), centre, hybrid, builder,
            select=f"SELECT player_id, {r('con', 'score_con')}, {r('def', 'score_def')}, {label} AS perfil_k3, "
            f"CASE WHEN cluster = h THEN CASE WHEN con >= def THEN '+ Construtor' ELSE '+ Defensivo' END END AS hybrid_lean FROM labelled, mid, top",
        )
    )


@query("c9_two_axis_profile", "C9 M1 M2 M4", _two_axis_sql())
def _(spark, folder):
    out = k.with_two_axis_profile(pool(spark, folder).where(C("family") == "zagueiros"), STARTS)
    return tidy(out, "player_id", "score_con", "score_def", "perfil_k3", "hybrid_lean")


# ------------------------------------------------------------------------------ components


def raw_features(spark, folder):
    return k.scaled_features(study_pool(spark, folder), RAW)


def unlabelled_features(spark, folder):
    """The features alone, for studies that read no current label: nothing else of the pool is written."""
    people = settle(pool(spark, folder).select("player_id", *RAW), "study")
    return k.scaled_features(people, RAW)[0].select("player_id", "features")


@query("m3_loadings", "M3")
def _(spark, folder):
    found = components.principal(raw_features(spark, folder)[0], len(RAW))
    shares = dict(zip((f"PC{i + 1}" for i in range(len(RAW))), found.shares()))
    rows = [(c, f, v, float(shares[c])) for c, f, v in components.loading_rows(found, RAW, len(RAW))]
    return tidy(spark.createDataFrame(rows, "component string, feature string, loading double, variance_share double"))


def _covariance(i: int, j: int) -> str:
    return f"covar_samp(x{i}, x{j})"


_SQUARE = " + ".join(f"{_covariance(i, j)} * {_covariance(i, j)}" for i in range(len(RAW)) for j in range(len(RAW)))


@query(
    "m3_certificate",
    "M3",
    study_sql(
        select=f"SELECT {r(' + '.join(_covariance(i, i) for i in range(len(RAW))), 'trace')}, {r(_SQUARE, 'square')}, 0e0 AS residual, 0e0 AS apart FROM feat"
    ),
)
def _(spark, folder):
    """Variances add up to the trace, their squares to the squared covariances; nothing is left over, components are orthonormal."""
    told = components.principal(raw_features(spark, folder)[0], len(RAW)).certificate()
    return tidy(spark.createDataFrame([tuple(told.values())], ", ".join(f"{n} double" for n in told)))


@query(
    "m3_scores",
    "M3 C19",
    study_sql(select=f"SELECT player_id, {r(' + '.join(f'x{i} * x{i}' for i in range(len(RAW))), 'square')}, 'PC' AS axes FROM feat"),
)
def _(spark, folder):
    """The scores on all components of a row keep its squared length, whatever the axes."""
    ready, _scale = raw_features(spark, folder)
    scored = components.with_scores(ready, components.principal(ready, len(RAW)), len(RAW))
    square = sum((C(f"pc{i + 1}") * C(f"pc{i + 1}") for i in range(1, len(RAW))), C("pc1") * C("pc1"))
    return tidy(scored.select("player_id", square.alias("square"), F.lit("PC").alias("axes")))


@query("m3_principal_components", "M3 T6 C19")
def _(spark, folder):
    ready, _scale = raw_features(spark, folder)
    found = components.principal(ready, len(RAW))
    rows = spark.createDataFrame(components.loading_rows(found, RAW, 3), "component string, feature string, loading double")
    share = F.create_map(*[F.lit(x) for i, v in enumerate(found.variances[:3]) for x in (f"PC{i + 1}", float(v))])
    scored = components.with_scores(ready, found, 3)
    sizes = scored.groupBy(k.raw_quadrant_labels(C("pc1"), C("pc2")).alias("label")).agg(F.count(F.lit(1)).alias("players"))
    top = components.top_loadings(rows).withColumn("variance", share[C("component")])
    members = sizes.select(
        F.lit("quadrant").alias("component"), F.lit(0).alias("place"), C("label").alias("feature"),
        C("players").cast("double").alias("loading"), F.lit(None).cast("double").alias("variance"),
    )
    return tidy(top.select("component", "place", "feature", "loading", "variance").unionByName(members))


# --------------------------------------------------------------------------------- K-means


@query(
    "m4_multi_start",
    "M4",
    study_sql(
        *ms.lloyd_ctes(KS, STARTS, len(RAW)),
        select=f"SELECT CAST(m.k AS INTEGER) AS k, CAST(m.s AS INTEGER) AS start, CAST(m.step AS INTEGER) AS steps, {r('m.cost', 'cost')}, m.s = c.s AS best "
        "FROM models m JOIN chosen c ON c.k = m.k",
    ),
)
def _(spark, folder):
    """Every start of every K, how far it went, and the one of least cost."""
    ready, _scale = raw_features(spark, folder)
    models = lloyd.advance(ready, lloyd.first_models(ready, KS, STARTS))
    chosen = lloyd.best(models)
    rows = [(m.k, m.start, m.steps, m.cost, chosen[m.k, None].start == m.start) for m in models]
    return tidy(spark.createDataFrame(rows, "k int, start int, steps int, cost double, best boolean"))


def _goal(terms: dict[str, float]) -> str:
    return " + ".join(f"{w!r} * (centres[c][{RAW.index(f) + 1}] * s{RAW.index(f)} + m{RAW.index(f)})" for f, w in terms.items())


RAW_SCORES = (
    "scores AS (SELECT k, c - 1 AS cluster, " + ", ".join(f"round({_goal(t)}, 9) AS \"{g}\"" for g, t in k.RAW_GOALS.items())
    + " FROM chosen, feat_scale, range(1, k + 1) t(c))"
)


@query(
    "m4_kmeans_labels",
    "M4 C20 A17",
    study_sql(
        *ms.lloyd_ctes((3,), STARTS, len(RAW)), ms.labelled_cte(len(RAW), "labelled"), RAW_SCORES,
        *ms.greedy_ctes("scores", list(k.RAW_GOALS), "k", "names_", config.HYBRID),
        select="SELECT player_id, archetype AS atual, CAST(l.cluster AS INTEGER) AS cluster, label, archetype <> label AS changed "
        "FROM labelled l JOIN names_ n ON n.k = l.k AND n.cluster = l.cluster",
    ),
)
def _(spark, folder):
    ready, scale = raw_features(spark, folder)
    model = lloyd.fit(ready, (3,), STARTS)[3]
    out = k.named(ready.withColumn("cluster", lloyd.cluster_of(model)), raw_names(spark, model.centres, scale), "label")
    return out.select("player_id", "atual", "cluster", "label", (C("atual") != C("label")).alias("changed"))


def raw_names(spark, centres, scale):
    scores = k.centroid_scores(spark, [k.unscale(c, RAW, scale) for c in centres], k.RAW_GOALS)
    rounded = scores.select("cluster", *[F.round(C(g), 9).alias(g) for g in k.RAW_GOALS])
    return k.unique_labels(rounded, list(k.RAW_GOALS), config.HYBRID)


_BANDS = "(age - 17) // 6"


@query(
    "c20_unique_labels",
    "C20",
    with_base(
        f"bands AS (SELECT family, CAST({_BANDS} AS INTEGER) AS cluster, "
        + ", ".join("round(" + " + ".join(f"{w!r} * avg({f})" for f, w in t.items()) + f", 9) AS \"{g}\"" for g, t in k.RAW_GOALS.items())
        + f" FROM pool GROUP BY family, {_BANDS})",
        *ms.greedy_ctes("bands", list(k.RAW_GOALS), "family", "names_", config.HYBRID),
        select="SELECT family, cluster, n.label, "
        + 'CASE greatest("Construtor", "Combativo", "Posicional") WHEN "Construtor" THEN \'Construtor\' WHEN "Combativo" THEN \'Combativo\' ELSE \'Posicional\' END AS dominant '
        + "FROM bands JOIN names_ n USING (family, cluster)",
    ),
)
def _(spark, folder):
    """Labels of a table of centroids (means by age band) per family, each label once and the strongest one."""
    people = pool(spark, folder)
    band = F.floor((C("age") - 17) / 6).cast("int").alias("cluster")
    scores = {g: sum((F.lit(w) * F.avg(f) for f, w in list(t.items())[1:]), F.lit(list(t.values())[0]) * F.avg(list(t)[0])) for g, t in k.RAW_GOALS.items()}
    bands = settle(people.groupBy("family", band).agg(*[F.round(e, 9).alias(g) for g, e in scores.items()]), "bands")
    names = list(k.RAW_GOALS)
    unique = k.unique_labels(bands, names, config.HYBRID, ["family"])
    return unique.join(k.dominant_labels(bands, names, ["family"]).withColumnRenamed("label", "dominant"), ["family", "cluster"])


CURRENT = [
    "cells AS (SELECT k, archetype AS a, cluster AS b, count(*)::DOUBLE AS n FROM labelled GROUP BY k, archetype, cluster)",
    *ms.rand_ctes("cells", "k", "agreement"),
]


@query(
    "m7_k_selection",
    "M4 M7 M8",
    study_sql(
        *ms.lloyd_ctes(KS, STARTS, len(RAW)), ms.labelled_cte(len(RAW), "labelled"), *ms.separation_ctes(len(RAW)), *CURRENT,
        select=f"SELECT CAST(k AS INTEGER) AS k, {r('silhouette', 'silhouette')}, {r('calinski', 'calinski')}, {r('davies_bouldin', 'davies_bouldin')}, {r('ari', 'ari')}, "
        "row_number() OVER (ORDER BY round(silhouette, 6) DESC, k) = 1 AS best_silhouette, row_number() OVER (ORDER BY round(calinski, 6) DESC, k) = 1 AS best_calinski, "
        "row_number() OVER (ORDER BY round(davies_bouldin, 6), k) = 1 AS best_davies_bouldin FROM separations JOIN agreement USING (k)",
    ),
)
def _(spark, folder):
    rows = k.k_selection(raw_features(spark, folder)[0], "atual", KS, STARTS)
    kinds = {"k": "int"} | {c: "double" for c in ("silhouette", "calinski", "davies_bouldin", "ari")}
    kinds |= {f"best_{c}": "boolean" for c in ("silhouette", "calinski", "davies_bouldin")}
    return tidy(spark.createDataFrame([tuple(x[c] for c in kinds) for x in rows], ", ".join(f"{c} {t}" for c, t in kinds.items())))


# --------------------------------------------------------------------------------- mixtures


@query("m5_mixture_selection", "M5 M7")
def _(spark, folder):
    """Mixtures of every K by likelihood and BIC, and the best K."""
    fits = mixtures.fit(raw_features(spark, folder)[0], KS, MIXTURE_STARTS)
    best = min(fits.values(), key=lambda m: (round(m.bic(), 6), m.k), default=None)
    rows = [(m.k, m.start, len(m.trace), m.likelihood, m.bic(), m is best) for m in fits.values()]
    return tidy(spark.createDataFrame(rows, "k int, start int, steps int, log_likelihood double, bic double, best boolean"))


LABELS = (config.AREA, config.BUILDER, config.COMBAT)
_DIMS = len(k.COMPOSITE_FEATURES)
_GROUPED = [
    *AXIS_CTES, *ms.feature_ctes("arch", k.COMPOSITE_FEATURES, "player_id, archetype"),
    *ms.group_mixture_ctes("feat", "archetype", _DIMS, mixtures.RIDGE),
    "most AS (SELECT player_id, max(v) AS top FROM dense GROUP BY player_id)",
    "shares AS (SELECT player_id, comp, top, exp(v - top) / sum(exp(v - top)) OVER (PARTITION BY player_id) AS p, "
    "top + ln(sum(exp(v - top)) OVER (PARTITION BY player_id)) AS log_density FROM dense JOIN most USING (player_id))",
]


def grouped_mixture(spark, folder):
    ready, _scale = k.scaled_features(study_pool(spark, folder), k.COMPOSITE_FEATURES)
    present = {x["atual"] for x in ready.select("atual").distinct().collect()}  # three labels at most
    names = [x for x in LABELS if x in present]
    return ready, names, mixtures.of_labels(ready, "atual", names, _DIMS)


@query(
    "m5_group_memberships",
    "M5 C18",
    with_base(
        *_GROUPED,
        select=f"SELECT player_id, {r('max(p)', 'confidence')}, {r('-sum(p * ln(p + 1e-12))', 'entropy')}, {r('any_value(log_density)', 'log_density')}, "
        f"CASE WHEN max(p) < 0.45 THEN '{config.HYBRID}' ELSE arg_max(comp, p) END AS gmm_label FROM shares GROUP BY player_id",
    ),
)
def _(spark, folder):
    """Memberships in the mixture whose components are the current archetypes."""
    ready, names, model = grouped_mixture(spark, folder)
    table_ = spark.createDataFrame(list(enumerate(names)), "cluster int, label string")
    return tidy(k.mixture_labels(ready, model, table_), "player_id", "confidence", "entropy", "log_density", "gmm_label")


_FREE = "(c - 1) + c * {d} + c * {d} * ({d} + 1) / 2e0".format(d=_DIMS)


@query(
    "m5_group_likelihood",
    "M5",
    with_base(
        *_GROUPED, "told AS (SELECT player_id, any_value(log_density) AS v FROM shares GROUP BY player_id)",
        "sums AS (SELECT sum(v) AS log_likelihood, count(*) AS n, (SELECT count(*) FROM groups_) AS c FROM told)",
        select=f"SELECT {r('log_likelihood', 'log_likelihood')}, {r(f'-2 * log_likelihood + ({_FREE}) * ln(n)', 'bic')} FROM sums",
    ),
)
def _(spark, folder):
    ready, _names, model = grouped_mixture(spark, folder)
    told = mixtures.step(ready, [model])[0]
    return tidy(spark.createDataFrame([(told.likelihood, told.bic())], "log_likelihood double, bic double"))


def composite_names(spark, centres, scale):
    raw = [k.unscale(c, k.COMPOSITE_FEATURES, scale) for c in centres]
    scores = k.centroid_scores(spark, k.scaled_centres(raw, k.COMPOSITE_FEATURES), k.COMPOSITE_GOALS)
    return k.unique_labels(scores, list(k.COMPOSITE_GOALS), config.HYBRID)


@query("c18_mixture_labels", "M5 C18 C20")
def _(spark, folder):
    ready, scale = k.scaled_features(study_pool(spark, folder), k.COMPOSITE_FEATURES)
    model = mixtures.fit(ready, (3,), OPTION_STARTS)[3]
    out = k.mixture_labels(ready, model, composite_names(spark, model.means, scale))
    tactical = F.create_map(*[F.lit(x) for pair in OPTION_NAMES.items() for x in pair])
    return tidy(out.withColumn("tactical", tactical[C("gmm_label")]), "player_id", "gmm_label", "tactical", "component", "confidence", "entropy")


# -------------------------------------------------------------------------------- hierarchy


def _tree_sql() -> str:
    d = len(RAW)
    x = ", ".join(f"x{i}" for i in range(d))
    mean = "[" + ", ".join(f"avg(x{i})" for i in range(d)) + "]"
    norm = " + ".join(f"(x{i} - m.c[{i + 1}]) * (x{i} - m.c[{i + 1}])" for i in range(d))
    return study_sql(
        f"root AS (SELECT {mean} AS c FROM feat)", f"zero AS (SELECT sum({norm}) AS scatter, count(*) AS n FROM feat, root m)",
        *ms.lloyd_ctes((2,), STARTS, d, name="_one"), ms.labelled_cte(d, "cut_one", "chosen_one", "points_one"),
        f"halves AS (SELECT player_id, {x}, cluster + 1 AS node FROM cut_one)",
        "sides AS (SELECT cluster + 1 AS node, count(*) AS n, sum(near) AS scatter FROM cut_one GROUP BY cluster)",
        "wide AS (SELECT node AS leaf FROM sides ORDER BY round(scatter, 6) DESC, node LIMIT 1)",
        *ms.lloyd_ctes((2,), STARTS, d, source="halves", name="_two", where="node = (SELECT leaf FROM wide)"),
        ms.labelled_cte(d, "cut_two", "chosen_two", "points_two"),
        "quarters AS (SELECT cluster + 3 AS node, count(*) AS n, sum(near) AS scatter FROM cut_two GROUP BY cluster)",
        "tree AS (SELECT 0 AS node, NULL AS parent, n, scatter, scatter - (SELECT sum(scatter) FROM sides) AS removed FROM zero "
        "UNION ALL SELECT node, 0, n, scatter, CASE WHEN node = leaf THEN scatter - (SELECT sum(scatter) FROM quarters) END FROM sides, wide "
        "UNION ALL SELECT node, leaf, n, scatter, NULL FROM quarters, wide)",
        select=f"SELECT CAST(node AS INTEGER) AS node, CAST(parent AS INTEGER) AS parent, n::BIGINT AS size, {r('scatter', 'scatter')}, {r('removed', 'removed')} FROM tree",
    )


@query("m6_bisected_tree", "M6", _tree_sql())
def _(spark, folder):
    """Which node was cut, what scatter each cut removed, and the leaves' sizes."""
    _rows, tree = k.bisected(raw_features(spark, folder)[0], 3, STARTS)
    rows = [(t["node"], t["parent"], t["size"], t["scatter"], t["removed"]) for t in tree]
    return tidy(spark.createDataFrame(rows, "node int, parent int, size long, scatter double, removed double"))


@query("m6_model_consensus", "M4 M5 M6 C17 C20 A16 A17")
def _(spark, folder):
    people = pool(spark, folder).where(C("family") == "zagueiros")
    blocks = with_blocks(people, ["zagueiros"])
    features = ["blk_construcao", "blk_conducao", "blk_duelos_def", "blk_duelo_ar", "blk_leitura"]
    ready, scale = k.scaled_features(blocks, features)
    km, gm = lloyd.fit(ready, (3,), STARTS)[3], mixtures.fit(ready, (3,), MIXTURE_STARTS)[3]
    leaves, tree = k.bisected(ready, 3, STARTS)
    ends = [t for t in tree if t["removed"] is None]

    def names(centres):
        scores = k.centroid_scores(spark, [k.unscale(c, features, scale) for c in centres], k.AXIS_GOALS)
        return k.dominant_labels(scores, list(k.AXIS_GOALS))

    out = k.named(leaves.withColumn("_km", lloyd.cluster_of(km)), names(km.centres), "kmeans", "_km")
    leaf = F.create_map(*[F.lit(x) for i, t in enumerate(ends) for x in (t["node"], i)])
    out = k.named(out.withColumn("_hc", leaf[C("node")]), names([t["centre"] for t in ends]), "hier", "_hc")
    out = k.mixture_labels(out, gm, names(gm.means)).withColumnRenamed("gmm_label", "gmm")
    return tidy(
        out.withColumn("consenso", labels.consensus(C("kmeans"), C("hier"), C("gmm"))),
        "player_id", "kmeans", "hier", "gmm", "confidence", "consenso",
    )


# -------------------------------------------------------------------------------- stability

_DRAWN = "CAST('0x' || substr(md5(rep || ':' || player_id), 1, 8) AS BIGINT)"
_WEIGHT = " + ".join(f"({_DRAWN} >= {x})::INT" for x in lloyd.weight_limits(0.8))


@query(
    "m9_resample_agreement",
    "M9",
    study_sql(
        f"drawn AS (SELECT player_id, rep, ({_WEIGHT})::DOUBLE AS v FROM feat, range({RESAMPLES}) t(rep))",
        "weights AS (SELECT player_id, list(v ORDER BY rep) AS w FROM drawn GROUP BY player_id)",
        "heavy AS MATERIALIZED (SELECT feat.*, w FROM feat JOIN weights USING (player_id))",
        *ms.lloyd_ctes(RESAMPLED_KS, 1, len(RAW)), ms.labelled_cte(len(RAW), "base"),
        *ms.lloyd_ctes(RESAMPLED_KS, 1, len(RAW), source="heavy", name="_again", weights=RESAMPLES),
        "cells AS (SELECT k * 1000 + rep AS t, k, rep, a, b, sum(times) AS n FROM (SELECT l.k, l.rep, f.w[l.rep + 1] AS times, b.cluster AS a, "
        f"list_transform(l.centres, lambda c: {ms.squared(len(RAW))}) AS apart, list_position(apart, list_min(apart)) AS b "
        "FROM chosen_again l, heavy f JOIN base b USING (player_id) WHERE b.k = l.k) WHERE times > 0 GROUP BY ALL)",
        *ms.rand_ctes("cells", "t", "agreement"),
        select=f"SELECT CAST(t // 1000 AS INTEGER) AS k, CAST(t % 1000 AS INTEGER) AS rep, {r('ari', 'ari')} FROM agreement",
    ),
)
def _(spark, folder):
    """Agreement of a fit from one start with its refits on 80 resamples, K 2 to 4."""
    return tidy(lloyd.bootstrap(unlabelled_features(spark, folder), RESAMPLED_KS, RESAMPLES, 1, 1), "k", "rep", "ari")


@query("m9_bootstrap_stability", "M9")
def _(spark, folder):
    """Mean agreement of the best of 20 starts with the best of 10 starts on each of 80 resamples, K 2 to 4."""
    told = lloyd.bootstrap(unlabelled_features(spark, folder), RESAMPLED_KS, RESAMPLES, RESAMPLED_STARTS, REFIT_STARTS)
    return tidy(told.groupBy("k").agg(F.avg("ari").alias("ari"), F.stddev_samp("ari").alias("sd"), F.count(F.lit(1)).alias("resamples")))


# ------------------------------------------------------------------------------- comparison


def compared_models(spark, folder):
    """The pool with the current label and those of every model, in one frame."""
    ready, scale = k.scaled_features(study_pool(spark, folder), k.COMPOSITE_FEATURES)
    ready = ready.withColumn("atual", F.when(C("atual") == config.AREA, "Posicional").otherwise(C("atual")))
    km = lloyd.fit(ready, (3,), STARTS)[3]
    out = k.named(ready.withColumn("_km", lloyd.cluster_of(km)), composite_names(spark, km.centres, scale), "kmeans", "_km")
    for n, model in mixtures.fit(ready, (3, 4), OPTION_STARTS).items():
        out = k.mixture_labels(out, model, composite_names(spark, model.means, scale))
        out = out.withColumnRenamed("gmm_label", f"mixture_{n}").drop("component", "confidence", "entropy", "membership", "log_density")
    out = components.with_scores(out, components.principal(ready, _DIMS), 2)
    margins = {f"quadrant_{round(100 * m)}": k.quadrant_labels(C("pc1"), C("pc2"), m) for m in MARGINS}
    return settle(out.withColumns({**margins, "current": C("atual")}).drop("features", "_km"), "models")


MODELS = ("current", "kmeans", "mixture_3", "mixture_4", *[f"quadrant_{round(100 * m)}" for m in MARGINS])


@query("m10_model_comparison", "M10 C18 C19 C20")
def _(spark, folder):
    out, result = compared_models(spark, folder), None
    for name in MODELS:
        counts = out.agg(*[F.count_if(C(name) == x).alias(x.lower().replace("í", "i")) for x in ORDER])
        agreed = k.label_agreement(out, "atual", name).select(F.lit(name).alias("model"), "*")
        row = agreed.join(counts.withColumn("model", F.lit(name)), "model")
        result = row if result is None else result.unionByName(row)
    return tidy(result)


@query("m10_confusions", "M10 A16")
def _(spark, folder):
    """Counts of current label by model label, every pair of the four labels, per model."""
    out, result = compared_models(spark, folder), None
    for name in MODELS[1:]:
        cells = k.confusion(out, "atual", name, ORDER).select(F.lit(name).alias("model"), "a", "b", "n")
        result = cells if result is None else result.unionByName(cells)
    return result


VECTOR_KS, VECTOR_STARTS, VECTOR_DIMS = (10,), 5, 64
_VECTORS = "vecs AS (SELECT vec_id AS player_id, label, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS e{i}" for i in range(VECTOR_DIMS)) + " FROM embeddings)"


@query(
    "m4_embedding_clusters",
    "M4 M8",
    ms.recursive(
        "WITH " + ", ".join(
            [
                _VECTORS, *ms.feature_ctes("vecs", [f"e{i}" for i in range(VECTOR_DIMS)], "player_id, label"),
                *ms.lloyd_ctes(VECTOR_KS, VECTOR_STARTS, VECTOR_DIMS), ms.labelled_cte(VECTOR_DIMS, "labelled"),
                "cells AS (SELECT k, label AS a, cluster AS b, count(*)::DOUBLE AS n FROM labelled GROUP BY k, label, cluster)",
                *ms.rand_ctes("cells", "k", "agreement"),
            ]
        )
        + f" SELECT CAST(c.k AS INTEGER) AS k, {r('cost', 'cost')}, {r('ari', 'ari')} FROM chosen c JOIN agreement a ON a.k = c.k"
    ),
)
def _(spark, folder):
    rows = table(spark, folder, "embeddings").select("vec_id", "label", F.col("embedding").alias("e"))
    wide = rows.select("vec_id", "label", *[F.get("e", i).cast("double").alias(f"x{i}") for i in range(VECTOR_DIMS)])
    ready, _scale = k.scaled_features(wide, [f"x{i}" for i in range(VECTOR_DIMS)])
    model = lloyd.fit(ready, VECTOR_KS, VECTOR_STARTS, id_col="vec_id")[VECTOR_KS[0]]
    agreed = k.label_agreement(ready.withColumn("cluster", lloyd.cluster_of(model)), "label", "cluster")
    return tidy(agreed.select(F.lit(model.k).alias("k"), F.lit(model.cost).alias("cost"), "ari"))
