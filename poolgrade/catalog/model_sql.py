"""SQL tables for the model studies: scaled features, K-means to its end, separations, agreement, Cholesky factors."""

from __future__ import annotations

from collections.abc import Sequence

from ..operators import lloyd


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def feature_ctes(source: str, columns: Sequence[str], keep: str, name: str = "feat") -> list[str]:
    """Population-scaled columns x0, x1, ... beside the columns ``keep``."""
    moments = ", ".join(f"avg(coalesce({c}, 0)) AS m{i}, stddev_pop(coalesce({c}, 0)) AS s{i}" for i, c in enumerate(columns))
    scaled = ", ".join(
        f"round((coalesce({c}, 0) - m{i}) / CASE WHEN s{i} = 0 THEN 1e0 ELSE s{i} END, {lloyd.DIGITS}) AS x{i}" for i, c in enumerate(columns)
    )
    return [
        f"{name}_scale AS (SELECT {moments} FROM {source})",
        f"{name} AS MATERIALIZED (SELECT {keep}, {scaled} FROM {source}, {name}_scale)",
    ]


def squared(dims: int, point: str = "f.x{i}", centre: str = "c[{j}]") -> str:
    terms = [f"({point} - {centre}) * ({point} - {centre})".format(i=i, j=i + 1) for i in range(dims)]
    return " + ".join(terms)


def lloyd_ctes(
    ks: Sequence[int], starts: int, dims: int, source: str = "feat", id_col: str = "player_id", name: str = "", weights: int = 0, where: str = "true"
) -> list[str]:
    """K-means of every k, start (and resample, if ``weights`` counts some) to its end: ``models``, and ``chosen`` of least cost.

    ``weights``: the source has a list ``w`` of so many weights.
    """
    x = ", ".join(f"x{i}" for i in range(dims))
    times = "f.w[l.rep + 1]" if weights else "1"
    sums = ", ".join(f"sum(times * x{i}) AS t{i}" for i in range(dims))
    means = ", ".join(f"round(t{i} / n, {lloyd.DIGITS}) + 0e0" for i in range(dims))
    reps = f"range({max(weights, 1)}) r(rep)"
    moves = "list_sum(list_transform(range(1, k + 1), lambda c: " + " + ".join(
        f"(fresh[c][{j}] - centres[c][{j}]) * (fresh[c][{j}] - centres[c][{j}])" for j in range(1, dims + 1)
    ) + "))"
    return [
        f"points{name} AS MATERIALIZED (SELECT * FROM {source} WHERE {where})",
        f"draws{name} AS (SELECT s, j, substr(md5(s || ':' || {id_col}), 1 + {lloyd.DRAW_HEX} * j, {lloyd.DRAW_HEX}) || {id_col} AS h, [{x}] AS p "
        f"FROM points{name}, range({starts}) a(s), range({max(ks)}) b(j))",
        f"firsts{name} AS (SELECT s, j, arg_min(p, h) AS p FROM draws{name} GROUP BY s, j)",
        f"""steps{name} AS (SELECT 0 AS step, k, s, rep, list(p ORDER BY j) AS centres, TRUE AS moved, 0e0 AS cost
        FROM firsts{name} JOIN (SELECT unnest([{", ".join(map(str, ks))}]) AS k) ON j < k, {reps} GROUP BY k, s, rep
      UNION ALL SELECT step + 1, k, s, rep, fresh, {moves} > {lloyd.STILL!r}, cost FROM (
        SELECT m.step, m.k, m.s, m.rep, m.centres, sum(cost) AS cost,
            list(CASE WHEN coalesce(n, 0) = 0 THEN m.centres[m.c] ELSE [{means}] END ORDER BY m.c) AS fresh
        FROM (SELECT step, k, s, rep, centres, unnest(range(1, k + 1)) AS c FROM steps{name} WHERE moved AND step < {lloyd.STEPS}) m
        LEFT JOIN (SELECT k, s, rep, label, sum(times) AS n, {sums}, sum(times * near) AS cost FROM (
            SELECT k, s, rep, times, {x}, list_min(apart) AS near, list_position(apart, list_min(apart)) AS label FROM (
              SELECT l.k, l.s, l.rep, {times} AS times, f.*, list_transform(l.centres, lambda c: {squared(dims)}) AS apart
              FROM steps{name} l, points{name} f WHERE l.moved AND l.step < {lloyd.STEPS})) GROUP BY k, s, rep, label) g
        ON g.k = m.k AND g.s = m.s AND g.rep = m.rep AND g.label = m.c GROUP BY m.step, m.k, m.s, m.rep, m.centres))""",
        f"models{name} AS (SELECT * FROM steps{name} WHERE step > 0 QUALIFY row_number() OVER (PARTITION BY k, s, rep ORDER BY step DESC) = 1)",
        f"chosen{name} AS (SELECT * FROM models{name} QUALIFY row_number() OVER (PARTITION BY k, rep ORDER BY round(cost, 6), s) = 1)",
    ]


def labelled_cte(dims: int, name: str, models: str = "chosen", points: str = "points") -> str:
    """Every row with its nearest centre (from 0), per k."""
    return (
        f"{name} AS MATERIALIZED (SELECT k, s, rep, * EXCLUDE (k, s, rep, apart), list_position(apart, list_min(apart)) - 1 AS cluster, list_min(apart) AS near "
        f"FROM (SELECT l.k, l.s, l.rep, f.*, l.centres, list_transform(l.centres, lambda c: {squared(dims)}) AS apart FROM {models} l, {points} f))"
    )


def separation_ctes(dims: int, labelled: str = "labelled") -> list[str]:
    """Per k: Calinski-Harabasz, Davies-Bouldin and squared silhouette as ``separations``."""
    x = [f"x{i}" for i in range(dims)]
    norm = " + ".join(f"{c} * {c}" for c in x)
    apart = " + ".join(f"(a.y{i} / a.n - b.y{i} / b.n) * (a.y{i} / a.n - b.y{i} / b.n)" for i in range(dims))
    middle = " + ".join(f"(y{i} / n - z{i} / total) * (y{i} / n - z{i} / total)" for i in range(dims))
    inner = " + ".join(f"f.x{i} * g.y{i}" for i in range(dims))
    return [
        f"groups_ AS (SELECT k, cluster, count(*) AS n, sum(near) AS w, sum(sqrt(near)) AS r, sum({norm}) AS psi, "
        + ", ".join(f"sum({c}) AS y{i}" for i, c in enumerate(x)) + f" FROM {labelled} GROUP BY k, cluster)",
        "whole AS (SELECT k, sum(n) AS total, count(*) AS groups, sum(w) AS within, " + ", ".join(f"sum(y{i}) AS z{i}" for i in range(dims)) + " FROM groups_ GROUP BY k)",
        f"between_ AS (SELECT k, total, groups, within, sum(n * ({middle})) AS between FROM groups_ JOIN whole USING (k) GROUP BY k, total, groups, within)",
        f"worst AS (SELECT a.k, a.cluster, max((a.r / a.n + b.r / b.n) / greatest(sqrt({apart}), 1e-12)) AS v FROM groups_ a JOIN groups_ b ON a.k = b.k AND a.cluster <> b.cluster GROUP BY a.k, a.cluster)",
        "spread AS (SELECT k, avg(v) AS davies_bouldin FROM worst GROUP BY k)",
        f"""means AS (SELECT f.k, f.player_id, f.cluster = g.cluster AS own, g.n, f.norm + g.psi / g.n - 2 * ({inner}) / g.n AS v
            FROM (SELECT *, {norm} AS norm FROM {labelled}) f JOIN groups_ g ON g.k = f.k)""",
        """sides AS (SELECT k, player_id, max(CASE WHEN own THEN n END) AS n, max(CASE WHEN own AND n > 1 THEN v * n / (n - 1) END) AS a, min(CASE WHEN NOT own THEN v END) AS b
            FROM means GROUP BY k, player_id)""",
        "shapes AS (SELECT k, avg(CASE WHEN n <= 1 OR b IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette FROM sides GROUP BY k)",
        "separations AS (SELECT k, silhouette, (between / (groups - 1)) / (within / (total - groups)) AS calinski, davies_bouldin FROM between_ JOIN spread USING (k) JOIN shapes USING (k))",
    ]


def rand_ctes(cells: str, by: str, out: str) -> list[str]:
    """Adjusted Rand index of counts (a, b, n) per ``by``."""
    pairs = "n * (n - 1) / 2e0"
    return [
        f"{out}_a AS (SELECT {by}, sum({pairs}) AS v FROM (SELECT {by}, a, sum(n) AS n FROM {cells} GROUP BY {by}, a) GROUP BY {by})",
        f"{out}_b AS (SELECT {by}, sum({pairs}) AS v FROM (SELECT {by}, b, sum(n) AS n FROM {cells} GROUP BY {by}, b) GROUP BY {by})",
        f"{out}_c AS (SELECT {by}, sum({pairs}) AS v, sum(n) AS whole_n FROM {cells} GROUP BY {by})",
        f"""{out} AS (SELECT {by}, CASE WHEN (a.v + b.v) / 2 = a.v * b.v / (whole_n * (whole_n - 1) / 2) THEN 1e0
            ELSE (c.v - a.v * b.v / (whole_n * (whole_n - 1) / 2)) / ((a.v + b.v) / 2 - a.v * b.v / (whole_n * (whole_n - 1) / 2)) END AS ari
            FROM {out}_a a JOIN {out}_b b USING ({by}) JOIN {out}_c c USING ({by}))""",
    ]


def greedy_ctes(source: str, labels: Sequence[str], by: str, out: str, rest: str) -> list[str]:
    """``out`` (by, cluster, label): each label in turn takes the free cluster of greatest score."""
    ctes, taken = [], []
    for n, label in enumerate(labels):
        free = " AND ".join(f"NOT EXISTS (SELECT 1 FROM {t} t WHERE t.{by} = g.{by} AND t.cluster = g.cluster)" for t in taken) or "true"
        ctes.append(
            f"{out}_{n} AS (SELECT {by}, cluster, '{label}' AS label FROM {source} g WHERE {free} "
            f"QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY \"{label}\" DESC, cluster) = 1)"
        )
        taken.append(f"{out}_{n}")
    given = " UNION ALL ".join(f"SELECT * FROM {t}" for t in taken)
    ctes.append(f"{out} AS (SELECT g.{by}, g.cluster, coalesce(t.label, '{rest}') AS label FROM {source} g LEFT JOIN ({given}) t ON t.{by} = g.{by} AND t.cluster = g.cluster)")
    return ctes


def group_mixture_ctes(source: str, group: str, dims: int, ridge: float) -> list[str]:
    """A Gaussian per group with its Cholesky factor, and every row's log densities: ``dense`` (row, comp, v)."""
    pairs = [(i, j) for i in range(dims) for j in range(i + 1)]
    ctes = [
        f"groups_ AS (SELECT {group} AS comp, count(*)::DOUBLE AS n, "
        + ", ".join(f"avg(x{i}) AS m{i}" for i in range(dims)) + ", "
        + ", ".join(f"sum(x{i} * x{j}) AS p{i}_{j}" for i, j in pairs) + f" FROM {source} GROUP BY {group})",
        "chol0 AS (SELECT *, " + ", ".join(f"p{i}_{j} / n - m{i} * m{j}" + (f" + {ridge!r}" if i == j else "") + f" AS v{i}_{j}" for i, j in pairs)
        + ", n / (SELECT sum(n) FROM groups_) AS weight FROM groups_)",
    ]
    for j in range(dims):
        done = " ".join(f"- l{j}_{q} * l{j}_{q}" for q in range(j))
        lead = f"sqrt(v{j}_{j} {done})"
        below = "".join(
            f", (v{i}_{j} " + " ".join(f"- l{i}_{q} * l{j}_{q}" for q in range(j)) + f") / {lead} AS l{i}_{j}" for i in range(j + 1, dims)
        )
        ctes.append(f"chol{j + 1} AS (SELECT *, {lead} AS l{j}_{j}{below} FROM chol{j})")
    ctes.append(f"fwd0 AS (SELECT f.*, g.* FROM {source} f, chol{dims} g)")
    for i in range(dims):
        done = " ".join(f"- l{i}_{q} * z{q}" for q in range(i))
        ctes.append(f"fwd{i + 1} AS (SELECT *, (x{i} - m{i} {done}) / l{i}_{i} AS z{i} FROM fwd{i})")
    square = " + ".join(f"z{i} * z{i}" for i in range(dims))
    logs = " + ".join(f"ln(l{i}_{i})" for i in range(dims))
    ctes.append(f"dense AS (SELECT player_id, comp, ln(weight) - ({logs}) - 0.5 * ({square} + {dims} * ln(2 * pi())) AS v FROM fwd{dims})")
    return ctes
