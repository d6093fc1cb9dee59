"""Dossiers, comparison, scatter and published outputs."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from .. import config
from ..functions import labels
from ..operators.identity import outfield
from ..plans import compare, dossier, publish
from ..plans.aspects import with_aspects
from ..session import scratch_dir, settle
from . import query
from .backs import season_frames
from .base import measured_columns, pct_ctes, pool, r, rounded, tidy, with_base
from .ratings import ASPECT_CTES, GENERIC, OVERALL_SQL, RATING_SQL, TENDENCY_SQL, blocks_ctes, profile_ctes

C = F.col
GENERIC_LIST = ", ".join(f"'{f}'" for f in GENERIC)


STORED: dict[tuple[str, str], tuple[str, object]] = {}


def stored_documents(spark, folder):
    """The documents of all six families, built once per application and tables and stored in the shared folder.

    The queries below read them as a site reads its stored documents; a copy that was released is built again.
    """
    key = (spark.sparkContext.applicationId, folder)
    if key in STORED:
        path = spark._jvm.org.apache.hadoop.fs.Path(STORED[key][0])
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return spark.read.schema(STORED[key][1]).parquet(STORED[key][0])
    # of past seasons the centre-backs' scores alone read anything, each family its own rows
    history, _target = season_frames(spark, folder, ["zagueiros"])
    docs = dossier.build_all(pool(spark, folder), history)
    path = os.path.join(scratch_dir(spark), "poolgrade", f"documents-{uuid.uuid4().hex}")
    docs.write.parquet(path)
    STORED[key] = (path, docs.schema)
    return spark.read.schema(docs.schema).parquet(path)


def _round(expr: str, places: int) -> str:
    """Half-even on the exact binary value, as the documents round."""
    return f"CAST(printf('%.{places}f', {expr}) AS DOUBLE)"


def _comma(expr: str, places: int = 1) -> str:
    return f"replace(printf('%.{places}f', {expr}), '.', ',')"


def _pct_text(expr: str) -> str:
    return f"printf('%.0f', {expr}) || '%'"


def _aspect_rows() -> str:
    """(group, place, label, percentile, display, efficiency, efficiency text) per aspect and family."""
    lat, spec = "family = 'laterais'", "family IN ('zagueiros', 'laterais')"
    inter = "CASE WHEN interception_won_p90 <> 0 THEN interception_won_p90 ELSE interceptions END"
    rows = [
        ("defensivos", 0, "'Duelos Defensivos'", "asp_duelos_def_vol", _comma("duels_def"), "asp_duelos_def_eff", _pct_text("duels_def_pct"), "TRUE"),
        ("defensivos", 1, "'Duelos Aéreos'", "asp_duelos_ar_vol", _comma("duels_air"), "asp_duelos_ar_eff", _pct_text("duels_air_pct"), "TRUE"),
        ("defensivos", 2, "'Eficiência Defensiva'", _round("asp_custo_def_eff", 1), "NULL", "NULL", "NULL", "TRUE"),
        ("construcao", 0, "'Passes Progressivos'", "asp_passes_prog_vol", _comma("passes_prog"), "asp_passes_prog_eff", _pct_text("passes_prog_pct"), "TRUE"),
        ("construcao", 1, "'Passes para Terço Final'", "asp_ptf_vol", _comma("passes_final"), "asp_ptf_eff", _pct_text("passes_final_pct"), "TRUE"),
        ("construcao", 2, "'Passes Longos'", "asp_passes_long_vol", _comma("passes_long"), "asp_passes_long_eff", _pct_text("passes_long_pct"), "TRUE"),
        ("construcao", 3, "'Distribuição'", "asp_passes_total_vol", "NULL", "NULL", "NULL", lat),
        ("perfil_construcao", 0, f"CASE WHEN {spec} THEN 'Tendência de Passe' ELSE 'Passes Longos' END", "asp_tend_long", _pct_text("long_share * 100e0"), "NULL", "NULL", "TRUE"),
        ("perfil_construcao", 1, "'Passes Progressivos'", "asp_tend_prog", _pct_text("prog_share * 100e0"), "NULL", "NULL", "TRUE"),
        ("perfil_defensivo", 0, "'Estilo de defesa'", "asp_def_style", _comma("style", 2), "NULL", "NULL", spec),
        ("perfil_defensivo", 1, "'Disciplina defensiva'", "asp_custo_def_eff", _pct_text("asp_faltas_vol"), "NULL", "NULL", spec),
        ("ofensivos", 0, "'Duelos Ofensivos'", "asp_duelos_of_vol", _comma("duels_off_net"), "asp_duelos_of_eff", _pct_text("duels_off_pct"), "TRUE"),
        ("ofensivos", 1, "'Conduções Progressivas'", "asp_prog_vol", _comma("carry_prog"), "NULL", "NULL", f"NOT {lat}"),
        ("ofensivos", 1, "'Progressão'", "greatest(asp_cond_prog_vol, asp_acel_vol)", "NULL", "NULL", "NULL", lat),
        ("ofensivos", 2, "'Dribles'", "asp_dribles_vol", _comma("dribbles"), "asp_dribles_eff", _pct_text("dribbles_pct"), lat),
        ("terco_final", 0, "'Cruzamentos'", "asp_cruz_vol", "NULL", "asp_cruz_eff", _pct_text("crosses_pct"), lat),
        ("terco_final", 1, "'Passes Finas'", "greatest(asp_passes_chave_vol, asp_passe_area_certos90)", "NULL", "NULL", "NULL", lat),
        ("terco_final", 2, "'Ofensividade'", "greatest(asp_acoes_at_vol, asp_toques_area_vol)", "NULL", "NULL", "NULL", lat),
    ]
    return " UNION ALL ".join(
        f"SELECT player_id, '{g}' AS grp, {p} AS place, {label} AS label, {_round(pct, 1)} AS percentile, CAST({shown} AS VARCHAR) AS display_value, "
        f"CAST({'NULL' if eff == 'NULL' else _round(eff, 1)} AS DOUBLE) AS efficiency_pct, CAST({text} AS VARCHAR) AS efficiency_value FROM doc WHERE {when}"
        for g, p, label, pct, shown, eff, text, when in rows
    )


DOC_CTE = """doc AS (SELECT asp.*, pool.* EXCLUDE (player_id, family, minutes_share, long_share, prog_share, fouls) FROM asp JOIN pool USING (player_id))"""
GRADE_SQL = "CASE WHEN percentile >= 85 THEN 'A' WHEN percentile >= 75 THEN 'B+' WHEN percentile >= 65 THEN 'B' WHEN percentile >= 55 THEN 'B-' WHEN percentile >= 45 THEN 'C+' WHEN percentile >= 35 THEN 'C' WHEN percentile >= 25 THEN 'C-' ELSE 'D' END"


@query(
    "o1_aspect_documents",
    "O1 C11",
    with_base(
        *ASPECT_CTES,
        DOC_CTE,
        f"items AS ({_aspect_rows()})",
        select=f"SELECT player_id, grp, CAST(place AS INTEGER) AS place, label, {GRADE_SQL} AS grade, percentile, display_value, efficiency_pct, efficiency_value FROM items",
    ),
)
def _(spark, folder):
    people = with_aspects(pool(spark, folder))
    docs = settle(people.select("player_id", *[e.alias(n) for n, e in dossier.aspect_groups().items()]), "aspects")
    groups = F.array(
        *[F.struct(F.lit(n).alias("grp"), C(n).alias("items")) for n in compare.ASPECT_GROUPS]
    )
    rows = docs.select("player_id", F.explode(groups).alias("g")).select(
        "player_id", "g.grp", F.posexplode("g.items").alias("place", "a")
    )
    return rows.select(
        "player_id", "grp", "place", "a.label", "a.grade", "a.percentile", "a.display_value", "a.efficiency_pct", "a.efficiency_value"
    )


# Aspects whose badge comes from two parts, by group and place; the others' comes from their own efficiency.
_PARTS = {
    ("defensivos", 2): ("asp_ad_vol", "asp_custo_def_eff"),
    ("construcao", 3): ("asp_passes_total_vol", "asp_rec_passes_vol"),
    ("ofensivos", 1): ("asp_cond_prog_vol", "asp_acel_vol"),
    ("terco_final", 1): ("asp_passes_chave_vol", "asp_passe_area_certos90"),
    ("terco_final", 2): ("asp_acoes_at_vol", "asp_toques_area_vol"),
}
_PART_ROWS = " UNION ALL ".join(
    f"SELECT player_id, '{g}' AS grp, {p} AS place, least({_round(a, 1)}, {_round(b, 1)}) AS least_part FROM doc WHERE family = 'laterais' OR '{g}' = 'defensivos'"
    for (g, p), (a, b) in _PARTS.items()
)


@query(
    "c12_aspect_badges",
    "C12 O1",
    with_base(
        *ASPECT_CTES, DOC_CTE, f"items AS ({_aspect_rows()})", f"parts AS ({_PART_ROWS})",
        "both_ AS (SELECT i.*, CASE WHEN least_part IS NOT NULL THEN least_part WHEN efficiency_pct IS NOT NULL THEN least(percentile, efficiency_pct) "
        "WHEN i.label = 'Conduções Progressivas' THEN percentile END AS v FROM items i LEFT JOIN parts USING (player_id, grp, place))",
        select="SELECT player_id, grp, CAST(place AS INTEGER) AS place, label, CASE WHEN v > 90 THEN 'gold' WHEN v > 75 THEN 'silver' WHEN v > 50 THEN 'bronze' END AS badge FROM both_",
    ),
)
def _(spark, folder):
    people = with_aspects(pool(spark, folder))
    docs = settle(people.select("player_id", *[e.alias(n) for n, e in dossier.aspect_groups().items()]), "aspects")
    groups = F.array(*[F.struct(F.lit(n).alias("grp"), C(n).alias("items")) for n in compare.ASPECT_GROUPS])
    rows = docs.select("player_id", F.explode(groups).alias("g")).select("player_id", "g.grp", F.posexplode("g.items").alias("place", "a"))
    return rows.select("player_id", "grp", "place", "a.label", labels.aspect_badge(C("a")).alias("badge"))


RATED_CTES = [
    *blocks_ctes(GENERIC),
    *profile_ctes(GENERIC),
    pct_ctes("idx", "pc", OVERALL_SQL | TENDENCY_SQL | {f"ip{i}": f"i{i}" for i in range(1, 5)}),
    "rat AS (SELECT *, " + RATING_SQL + " AS rating_geral, " + ", ".join(
        f"CASE WHEN i{i} IS NULL THEN NULL ELSE round(5e0 + ip{i} * 0.045e0 * 0.88e0 * (1e0 + minutes_share * 0.15e0), 9) END AS rating_{i}"
        for i in range(1, 5)
    ) + " FROM pc)",
    "full_doc AS (SELECT rat.*, perfil, s1, s2, s3, s4, rank() OVER (PARTITION BY rat.family ORDER BY rating_geral DESC) AS rank_geral FROM rat JOIN prof USING (player_id) JOIN (SELECT player_id, s1, s2, s3, s4 FROM shr) USING (player_id))",
]


@query(
    "o2_dossiers",
    "O2 O3 O9",
    with_base(
        *RATED_CTES,
        select="SELECT player_id, label, position, family AS position_family, profile, rating, minutes_pct, goals, rank_geral, construcao, contencao, first_share FROM ("
        "SELECT player_id, label, position, family, perfil AS profile, " + _round("rating_geral", 1) + " AS rating, " + _round("minutes_share * 100e0", 1)
        + " AS minutes_pct, CAST(goals AS INTEGER) AS goals, CAST(rank_geral AS BIGINT) AS rank_geral, " + _round("n_construcao", 0) + " AS construcao, "
        + _round("n_leitura_def", 0) + " AS contencao, " + _round("s1 * 100e0", 0) + " AS first_share FROM full_doc)",
    ),
)
def _(spark, folder):
    docs = dossier.build_generic(pool(spark, folder))
    first = {f: list(config.FAMILIES[f].indices)[0] for f in GENERIC}
    key = F.create_map(*[F.lit(x) for pair in first.items() for x in pair])
    return docs.select(
        "player_id", "label", "position", "position_family", "profile", "rating", "minutes_pct", "goals",
        C("ranks")["geral"].alias("rank_geral"), "tendencies.construcao", "tendencies.contencao",
        F.try_element_at(C("profile_shares"), key[C("position_family")]).alias("first_share"),
    )


def _scatter_sql(key: str) -> str:
    """Value of a scatter metric by family; a family without it has 0."""
    cells = " ".join(f"WHEN '{f}' THEN coalesce({x.scatter[key]}, 0e0)" for f, x in config.FAMILIES.items() if key in x.scatter)
    return f"CASE family {cells} ELSE 0e0 END"


@query(
    "o4_scatter",
    "O4 A9",
    with_base(
        f"pts AS (SELECT family, player_id, label, {_scatter_sql('xa')} AS x, {_scatter_sql('progressao')} AS y FROM pool)",
        select="SELECT family AS position_family, player_id, label, " + rounded("x y") + ", " + r("avg(x) OVER (PARTITION BY family)", "avg_x") + ", "
        + r("avg(y) OVER (PARTITION BY family)", "avg_y") + " FROM pts",
    ),
)
def _(spark, folder):
    docs = stored_documents(spark, folder)
    return tidy(compare.scatter_points(docs, "xa", "progressao"), "position_family", "player_id", "label", "x", "y", "avg_x", "avg_y")


def _pairs(docs):
    """Every player against the best rated of the family (an id that many pairs share)."""
    best = docs.groupBy("position_family").agg(F.min_by("player_id", F.struct(-C("rating"), C("player_id"))).alias("id_b"))
    return docs.join(F.broadcast(best), "position_family").where(C("player_id") != C("id_b")).select(
        C("player_id").alias("id_a"), "id_b"
    )


PROFILE_KEYS = {
    "meio-campistas": (2, 1, 3, 4),
    "extremos": (1, 2, 3),
    "meias-ofensivos": (1, 2),
    "atacantes": (1, 2, 3),
}
VERSUS_CTES = [
    *RATED_CTES,
    "card AS (SELECT player_id, family, " + _round("rating_geral", 1) + " AS geral, " + ", ".join(
        f"coalesce({_round(f'coalesce(rating_{i}, 0)', 1)}, 0) AS g{i}, coalesce({_round(f'coalesce(s{i}, 0) * 100e0', 0)}, 0) AS h{i}" for i in range(1, 5)
    ) + ", " + ", ".join(
        f"{_round(v, 0)} AS t{i}" for i, v in enumerate(("n_construcao", "n_conducao", "n_duelos_def", "n_leitura_def", "n_duelo_ar"))
    ) + " FROM full_doc)",
    "top AS (SELECT family, player_id AS id_b FROM card QUALIFY row_number() OVER (PARTITION BY family ORDER BY geral DESC, player_id) = 1)",
    "duo AS (SELECT card.player_id AS id_a, id_b FROM card JOIN top USING (family) WHERE card.player_id <> id_b)",
]


@query(
    "o6_head_to_head",
    "O6 J18 U2",
    with_base(
        *VERSUS_CTES,
        *ASPECT_CTES,
        DOC_CTE,
        f"items AS ({_aspect_rows()})",
        "fig AS (SELECT player_id, 'rating' AS kind, 'geral' AS k, geral AS v FROM card UNION ALL "
        + " UNION ALL ".join(
            f"SELECT player_id, 'profiles', 'p{i}', g{i} FROM card WHERE {i} <= CASE family WHEN 'meio-campistas' THEN 4 WHEN 'meias-ofensivos' THEN 2 ELSE 3 END" for i in range(1, 5)
        )
        + " UNION ALL " + " UNION ALL ".join(f"SELECT player_id, 'tendencies', 't{i}', t{i} FROM card" for i in range(5))
        + " UNION ALL SELECT items.player_id, 'aspects', grp || '|' || label, percentile FROM items JOIN card USING (player_id))",
        select="SELECT id_a, id_b, count(*) FILTER (x.v > y.v) AS wins_a, count(*) FILTER (x.v < y.v) AS wins_b, count(*) AS total FROM duo "
        "JOIN fig x ON x.player_id = id_a JOIN fig y ON y.player_id = id_b AND x.kind = y.kind AND x.k = y.k GROUP BY id_a, id_b",
    ),
)
def _(spark, folder):
    docs = settle(dossier.build_generic(pool(spark, folder)), "docs")
    return compare.verdict(compare.versus_metrics(_pairs(docs), compare.comparison_cards(docs)))


def _regulars(docs):
    """Every player against the one of most minutes in the family."""
    first = docs.groupBy("position_family").agg(F.min_by("player_id", F.struct(-C("minutes"), C("player_id"))).alias("id_b"))
    return docs.join(F.broadcast(first), "position_family").where(C("player_id") != C("id_b")).select(C("player_id").alias("id_a"), "id_b")


@query(
    "j18_aspect_table",
    "J18 U2 O6",
    with_base(
        *ASPECT_CTES,
        DOC_CTE,
        f"items AS ({_aspect_rows()})",
        "top AS (SELECT family, player_id AS id_b FROM pool QUALIFY row_number() OVER (PARTITION BY family ORDER BY minutes DESC, player_id) = 1)",
        "duo AS (SELECT pool.player_id AS id_a, id_b FROM pool JOIN top USING (family) WHERE pool.player_id <> id_b)",
        select="SELECT id_a, id_b, x.grp AS aspect_group, x.label, x.percentile AS value_a, y.percentile AS value_b, CASE WHEN x.percentile = y.percentile THEN 'tie' WHEN x.percentile > y.percentile THEN 'a' ELSE 'b' END AS leads "
        "FROM duo JOIN items x ON x.player_id = id_a JOIN items y ON y.player_id = id_b AND x.grp = y.grp AND x.label = y.label",
        once=True,
    ),
)
def _(spark, folder):
    docs = stored_documents(spark, folder)
    return compare.aspect_table(_regulars(docs), compare.comparison_cards(docs))


@query(
    "o13_share_table",
    "O13",
    with_base(
        *VERSUS_CTES,
        select=" UNION ALL ".join(
            f"SELECT id_a, id_b, '{key}' AS key, x.h{i} AS value_a, y.h{i} AS value_b FROM duo JOIN card x ON x.player_id = id_a JOIN card y ON y.player_id = id_b WHERE x.family = '{f}' AND (x.h{i} > 0 OR y.h{i} > 0)"
            for f in GENERIC for i, key in enumerate(config.FAMILIES[f].indices, 1)
        ),
    ),
)
def _(spark, folder):
    docs = settle(dossier.build_generic(pool(spark, folder)), "docs")
    return compare.share_table(_pairs(docs), compare.comparison_cards(docs))


@query("o2_all_families", "O1 O2 O3 O9 N4 N20 N22 C9")
def _(spark, folder):
    docs = stored_documents(spark, folder)
    return docs.select("player_id", "position_family", "profile", "rating", "hybrid_lean", F.to_json("ratings").alias("ratings"))


_PROFILES = "CASE family " + " ".join(f"WHEN '{f}' THEN '{'|'.join(x.profiles)}'" for f, x in config.FAMILIES.items()) + " END"
CONTENT = [
    *ASPECT_CTES, DOC_CTE, f"items AS ({_aspect_rows()})",
    "flat AS (SELECT player_id, count(*) AS aspects, sum(percentile) AS percentiles, string_agg(label, '|' ORDER BY grp, place) AS labels FROM items GROUP BY player_id)",
]
CONTENT_SQL = (
    f"SELECT p.player_id, family AS position_family, p.name, club, p.label, position, nationality, birth_year, height, foot, minutes, {_round('minutes_share * 100e0', 1)} AS minutes_pct, "
    f"CAST(goals AS INTEGER) AS goals, CAST(assists AS INTEGER) AS assists, {_PROFILES} AS profiles, f.aspects, {r('f.percentiles', 'percentiles')}, f.labels FROM pool p JOIN flat f USING (player_id)"
)
_CONTENT_FIELDS = (
    "player_id string, position_family string, name string, club string, label string, position string, nationality string, birth_year int, height int, foot string, "
    "minutes int, minutes_pct double, goals int, assists int"
)
_ASPECT_ITEMS = "array<struct<label:string,percentile:double>>"


def content(docs):
    """The fields of each document, its aspects counted, added up and named in order."""
    none = F.array().cast(_ASPECT_ITEMS)
    pick = lambda a: F.struct(a["label"].alias("label"), a["percentile"].alias("percentile"))
    every = F.flatten(F.array(*[F.coalesce(F.transform(f"aspects.{g}", pick), none) for g in sorted(compare.ASPECT_GROUPS)]))
    docs = docs.withColumn("_all", every)
    return docs.select(
        *[x.split(" ")[0] for x in _CONTENT_FIELDS.split(", ")],
        F.array_join("profiles_available", "|").alias("profiles"),
        F.size("_all").cast("long").alias("aspects"),
        F.aggregate("_all", F.lit(0.0), lambda t, a: t + a["percentile"]).alias("percentiles"),
        F.array_join(F.transform("_all", lambda a: a["label"]), "|").alias("labels"),
    )


@query("o2_contents", "O1 O2 O9", with_base(*CONTENT, select=CONTENT_SQL))
def _(spark, folder):
    """Documents of all six families, field by field."""
    return tidy(content(stored_documents(spark, folder)))


@query("o8_archetype_table", "O8 T3")
def _(spark, folder):
    from ..plans.fullbacks import rate_fullbacks

    people = settle(pool(spark, folder).where(C("family") == "laterais"), "people")
    docs = settle(dossier.dossiers(with_aspects(people), dossier.fullback_cards(rate_fullbacks(people))), "docs")
    cards = compare.comparison_cards(docs)
    mix = compare.ordered_mix(cards).where(C("place") == 0).select(C("player_id").alias("id_a"), C("key").alias("first_a"))
    return tidy(compare.archetype_table(_pairs(docs), cards).join(mix, "id_a"))


@query(
    "o10_site_meta",
    "O10 A5 A6 A7",
    with_base(
        select="SELECT 'Série A' AS league, (SELECT count(*) FROM pool) AS player_count, "
        "count(DISTINCT club) AS clubs, count(DISTINCT nationality) AS nationalities, min(height) FILTER (height > 0) AS height_min, max(height) FILTER (height > 0) AS height_max, "
        "max(minutes) AS minutes_max, min(birth_year) AS birth_min, max(birth_year) AS birth_max, " + ", ".join(f"(SELECT count(*) FROM pool WHERE family = '{f}') AS n{i}" for i, f in enumerate(config.FAMILIES)) + " "
        "FROM meas WHERE position IS NOT NULL AND position <> 'Goleiro'",
    ),
)
def _(spark, folder):
    people = measured_columns(spark, folder, *publish.META_FIELDS)
    docs = stored_documents(spark, folder)
    meta = publish.site_meta(docs, outfield(people), "parquet", "Série A", "2025/26")
    facets = publish.site_facets(outfield(people)).agg(
        F.count_if(C("facet") == "club").alias("clubs"), F.count_if(C("facet") == "nationality").alias("nationalities")
    )
    return meta.join(facets.select("*", F.lit("Série A").alias("league")), "league").select(
        "league",
        "player_count",
        "clubs",
        "nationalities",
        C("filters.height")[0].alias("height_min"),
        C("filters.height")[1].alias("height_max"),
        C("filters.minutes")[1].alias("minutes_max"),
        C("filters.birth_year")[0].alias("birth_min"),
        C("filters.birth_year")[1].alias("birth_max"),
        *[F.expr(f"filter(families, f -> f.key = '{f}')[0].count").alias(f"n{i}") for i, f in enumerate(config.FAMILIES)],
    )


@query("o11_written_site", "O9 O11 S6", with_base(*CONTENT, select=CONTENT_SQL))
def _(spark, folder):
    """The written documents of all six families, read back and compared field by field."""
    people = measured_columns(spark, folder, *publish.META_FIELDS)
    docs = stored_documents(spark, folder)
    meta = publish.site_meta(docs, outfield(people), "parquet", "Série A", "2025/26")
    facets = publish.site_facets(outfield(people))
    paths = publish.write_site(docs, meta, facets, os.path.join(scratch_dir(spark), "poolgrade", f"site-{uuid.uuid4().hex}"))
    groups = ", ".join(f"{g}:{_ASPECT_ITEMS}" for g in compare.ASPECT_GROUPS)
    written = spark.read.schema(f"{_CONTENT_FIELDS}, profiles_available array<string>, aspects struct<{groups}>").json(paths["dossiers"])
    return tidy(content(written))
