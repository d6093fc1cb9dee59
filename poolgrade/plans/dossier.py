"""Dossiers: one nested document per player, assembled from the rated pools."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.labels import letter_grade
from ..functions.scalar import comma_text, exact_round, exact_text
from ..session import settle
from .aspects import with_aspects
from .families import by_family, rate_families

C = F.col

ASPECT_FIELDS = {
    "label": "string",
    "kind": "string",
    "grade": "string",
    "percentile": "double",
    "display_value": "string",
    "certos_per90": "double",
    "efficiency_pct": "double",
    "efficiency_value": "string",
    "share_pct": "double",
    "pool_avg_pct": "double",
    "scale_max_pct": "double",
    "bar_key": "string",
    "axis_left": "string",
    "axis_right": "string",
    "pair_badge": "array<double>",
    "sub_metrics": "array<struct<label:string,percentile:double,display_value:string>>",
    "stats": "array<struct<label:string,percentile:double>>",
}


def _asp(key: str) -> Column:
    return F.coalesce(C(f"asp_{key}"), F.lit(0.0))


def _aspect(label: str, kind: str, percentile: Column, **fields: Column | None) -> Column:
    """One aspect; fields that do not apply are null and stay out of the written JSON."""
    pct = exact_round(percentile, 1)
    values = {"label": F.lit(label), "kind": F.lit(kind), "grade": letter_grade(pct), "percentile": pct} | fields
    return F.struct(
        *[
            (values[n].cast(t) if values.get(n) is not None else _absent(n, t)).alias(n)
            for n, t in ASPECT_FIELDS.items()
        ]
    )


def _absent(name: str, kind: str) -> Column:
    return F.array().cast(kind) if name == "stats" else F.lit(None).cast(kind)


def _sub(label: str, percentile: Column, display: Column) -> Column:
    return F.struct(
        F.lit(label).alias("label"), exact_round(percentile, 1).alias("percentile"), display.alias("display_value")
    )


def _percent_text(column: str) -> Column:
    return F.concat(exact_text(C(column), 0), F.lit("%"))


def _metric(label: str, key: str, column: str, eff: tuple[str, str] | None = None) -> Column:
    extra = {}
    if eff:
        extra = {"efficiency_pct": exact_round(_asp(eff[0]), 1), "efficiency_value": _percent_text(eff[1])}
    return _aspect(label, "metric", _asp(key), display_value=comma_text(C(column)), **extra)


def _passes(label: str, column: str, volume: str, eff: str, raw: str) -> Column:
    return _aspect(
        label,
        "pass_certos",
        _asp(volume),
        certos_per90=exact_round(C(column), 2),
        display_value=comma_text(C(column)),
        efficiency_pct=exact_round(_asp(eff), 1),
        efficiency_value=_percent_text(raw),
    )


def _group(label: str, percentile: Column, subs: Sequence[Column], **fields: Column) -> Column:
    return _aspect(label, "metric_group", percentile, sub_metrics=F.array(*subs), **fields)


def _share(
    label: Column | str, share: Column, mean: Column, scale: Column, percentile: Column, bar: Sequence | None = None,
    display: Column | None = None,
) -> Column:
    key, left, right = (F.lit(x) for x in bar) if bar else (None, None, None)
    return _aspect(
        label,
        "construction_share",
        percentile,
        display_value=display if display is not None else F.concat(exact_text(share, 0), F.lit("%")),
        share_pct=exact_round(share, 1),
        pool_avg_pct=exact_round(mean, 1),
        scale_max_pct=exact_round(scale, 1),
        bar_key=key,
        axis_left=left,
        axis_right=right,
    )


def _first_set(*columns: str) -> Column:
    """The first value that is neither null nor 0."""
    out = F.lit(0.0)
    for column in reversed(columns):
        out = F.when(F.coalesce(C(column), F.lit(0.0)) != 0, C(column)).otherwise(out)
    return out


def aspect_groups() -> dict[str, Column]:
    """The six aspect groups; their items depend on the family."""
    fullback = C("family") == "laterais"
    spectrum = C("family").isin("zagueiros", "laterais")
    inter, clear = _first_set("interception_won_p90", "interceptions"), _first_set("total_clearance_p90", "clearances")
    eff, acts = exact_round(_asp("custo_def_eff"), 1), exact_round(_asp("ad_vol"), 1)
    defence = F.array(
        _metric("Duelos Defensivos", "duelos_def_vol", "duels_def", ("duelos_def_eff", "duels_def_pct")),
        _metric("Duelos Aéreos", "duelos_ar_vol", "duels_air", ("duelos_ar_eff", "duels_air_pct")),
        _aspect(
            "Eficiência Defensiva",
            "def_efficiency_group",
            eff,
            pair_badge=F.array(acts, eff),
            sub_metrics=F.array(
                _sub("Ações bem-sucedidas", acts, comma_text(C("acoes_def_comp"))),
                _sub("Interceptações", _asp("inter_vol"), comma_text(inter)),
                _sub("Rebatidas", _asp("cortes_vol"), comma_text(clear)),
                _sub("Eficiência Defensiva", eff, comma_text(C("custo_def_raw"), 2)),
            ),
        ),
    )
    build = [
        _passes("Passes Progressivos", "passes_prog", "passes_prog_vol", "passes_prog_eff", "passes_prog_pct"),
        _passes("Passes para Terço Final", "passes_final", "ptf_vol", "ptf_eff", "passes_final_pct"),
        _passes("Passes Longos", "passes_long", "passes_long_vol", "passes_long_eff", "passes_long_pct"),
    ]
    distribution = _group(
        "Distribuição",
        _asp("passes_total_vol"),
        [
            _sub("Passes", _asp("passes_total_vol"), comma_text(C("passes"))),
            _sub("Passes Recebidos", _asp("rec_passes_vol"), comma_text(C("recv"))),
        ],
    )
    off_duels = _metric("Duelos Ofensivos", "duelos_of_vol", "duels_off_net", ("duelos_of_eff", "duels_off_pct"))
    progress = _group(
        "Progressão",
        F.greatest(_asp("cond_prog_vol"), _asp("acel_vol")),
        [
            _sub("Conduções Progressivas", _asp("cond_prog_vol"), comma_text(C("carry_prog"))),
            _sub("Acelerações", _asp("acel_vol"), comma_text(C("accels"))),
        ],
    )
    dribbles = _metric("Dribles", "dribles_vol", "dribbles", ("dribles_eff", "dribbles_pct"))
    carries = _metric("Conduções Progressivas", "prog_vol", "carry_prog")

    long_scale = F.when(C("family") == "zagueiros", 24.0).otherwise(C("scale_share_long"))
    long_args = (C("share_long_pct"), C("pool_avg_share_long"), long_scale, _asp("tend_long"))
    prog_args = (C("share_prog_pct"), C("pool_avg_share_prog"), C("scale_share_prog"), _asp("tend_prog"))
    style = F.when(
        spectrum,
        F.array(
            _share("Tendência de Passe", *long_args, ("pass_tendency", "Curto", "Longo")),
            _share("Passes Progressivos", *prog_args, ("progressive_share", "Baixo", "Alto")),
        ),
    ).otherwise(F.array(_share("Passes Longos", *long_args), _share("Passes Progressivos", *prog_args)))
    defence_style = F.array(
        _share(
            "Estilo de defesa",
            _asp("def_style"),
            C("pool_avg_def_m4"),
            F.lit(100.0),
            _asp("def_style"),
            ("def_contact_style", "Cobertura", "Agressivo"),
            comma_text(C("def_m4_ratio"), 2),
        ),
        _share(
            "Disciplina defensiva",
            _asp("faltas_vol"),
            C("pool_avg_faltas"),
            F.lit(100.0),
            _asp("custo_def_eff"),
            ("def_foul_style", "Disciplinado", "Faltoso"),
        ),
    )
    final_third = F.array(
        _group(
            "Cruzamentos",
            _asp("cruz_vol"),
            [
                _sub("Cruzamentos", _asp("cruz_vol"), comma_text(C("crosses"))),
                _sub("Eficiência", _asp("cruz_eff"), _percent_text("crosses_pct")),
            ],
            efficiency_pct=exact_round(_asp("cruz_eff"), 1),
            efficiency_value=_percent_text("crosses_pct"),
        ),
        _group(
            "Passes Finas",
            F.greatest(_asp("passes_chave_vol"), _asp("passe_area_certos90")),
            [
                _sub("Passes Chave", _asp("passes_chave_vol"), comma_text(C("passes_key"))),
                _sub("Passes para Área", _asp("passe_area_certos90"), comma_text(C("box_done"))),
            ],
        ),
        _group(
            "Ofensividade",
            F.greatest(_asp("acoes_at_vol"), _asp("toques_area_vol")),
            [
                _sub("Ações Ofensivas", _asp("acoes_at_vol"), comma_text(C("att_actions"))),
                _sub("Toques na Área", _asp("toques_area_vol"), comma_text(C("touches_box"))),
            ],
        ),
    )
    return {
        "defensivos": defence,
        "construcao": F.when(fullback, F.array(*build, distribution)).otherwise(F.array(*build)),
        "perfil_construcao": style,
        "perfil_defensivo": F.when(spectrum, defence_style).otherwise(F.slice(defence_style, 1, 0)),
        "ofensivos": F.when(fullback, F.array(off_duels, progress, dribbles)).otherwise(F.array(off_duels, carries)),
        "terco_final": F.when(fullback, final_third),
    }


# ------------------------------------------------------------------------ rating cards


def _map(entries: dict[str, Column]) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(k) for k in entries]), F.array(*entries.values()))


def _tendencies(df: DataFrame) -> Column:
    sources = dict(zip(config.TENDENCIES, ("n_construcao", "n_conducao", "n_duelos_def", "n_contencao", "n_duelo_ar")))
    if "n_contencao" not in df.columns:
        sources["contencao"] = "n_leitura_def"
    return F.struct(*[exact_round(F.coalesce(C(v), F.lit(0.0)), 0).alias(k) for k, v in sources.items()])


def _scatter_sources(df: DataFrame) -> Column:
    """Tendency values the scatter plot shows, next to the measures."""
    names = [n for n in ("n_construcao", "n_conducao", "n_duelo_ar", "n_contencao") if n in df.columns]
    return _map({n: C(n) for n in names})


EMPTY_CLUSTER = "struct<family:string,archetype:string,badge:string,badge_short:string,shares:map<string,double>,ratings:map<string,double>>"


def generic_cards(rated: DataFrame, families: Sequence[str] = config.GENERIC_FAMILIES) -> DataFrame:
    """Ratings, ranks, shares and tendencies of the families with profile indices."""
    ratings, ranks, shares = {}, {}, {}
    for f in families:
        keys = list(config.FAMILIES[f].indices)
        ratings[f] = _map(
            {"geral": exact_round(C("rating_geral"), 1)}
            | {k: exact_round(C(f"rating_{i + 1}"), 1) for i, k in enumerate(keys)}
        )
        ranks[f] = _map({"geral": C("rank_geral")} | {k: C(f"rank_{i + 1}") for i, k in enumerate(keys)})
        shares[f] = _map({k: exact_round(C(f"share_{i + 1}") * 100, 0) for i, k in enumerate(keys)})
    return rated.select(
        "player_id",
        exact_round(C("rating_geral"), 1).alias("rating"),
        by_family(ratings).alias("ratings"),
        by_family(ranks).alias("ranks"),
        by_family(shares).alias("profile_shares"),
        C("perfil").alias("profile"),
        F.lit(None).cast("string").alias("hybrid_lean"),
        F.lit(None).cast(EMPTY_CLUSTER).alias("cluster"),
        _tendencies(rated).alias("tendencies"),
        _scatter_sources(rated).alias("shown"),
    )


def _cluster(family: str, badge: str, shares: dict[str, str], ratings: dict[str, str]) -> Column:
    return F.struct(
        F.lit(family).alias("family"),
        C("cluster_archetype").alias("archetype"),
        C(badge).alias("badge"),
        C(f"{badge}_short").alias("badge_short"),
        _map({k: C(v) for k, v in shares.items()}).alias("shares"),
        _map({k: exact_round(C(v), 1) for k, v in ratings.items()}).alias("ratings"),
    ).cast(EMPTY_CLUSTER)


def fullback_cards(rated: DataFrame) -> DataFrame:
    keys = ("defensivo", "construtor", "ofensivo")
    return rated.select(
        "player_id",
        C("rating_geral").alias("rating"),
        _map({"geral": C("rating_geral")} | {k: C(f"rating_{k}") for k in keys}).alias("ratings"),
        _map({k: C(f"rank_{k}") for k in ("geral", *keys)}).alias("ranks"),
        _map({k: exact_round(C(f"cluster_share_{k}"), 0) for k in keys}).alias("profile_shares"),
        C("perfil").alias("profile"),
        F.lit(None).cast("string").alias("hybrid_lean"),
        _cluster(
            "laterais",
            "cluster_hybrid_badge",
            {k: f"cluster_share_{k}" for k in keys},
            {k: f"rating_{k}" for k in keys},
        ).alias("cluster"),
        _tendencies(rated).alias("tendencies"),
        _scatter_sources(rated).alias("shown"),
    )


def centreback_cards(rated: DataFrame) -> DataFrame:
    """Needs ``score_con``, ``score_def`` and ``hybrid_lean`` of the two-axis clustering."""
    whole = C("score_con") + C("score_def")
    whole = F.when(whole == 0, 1.0).otherwise(whole)
    arch = ("defensor_area", "construtor", "combativo")
    return rated.select(
        "player_id",
        C("rating_geral").alias("rating"),
        _map({k: C(f"rating_{n}") for k, n in _CB_KEYS.items()}).alias("ratings"),
        _map({k: C(f"rank_{n}") for k, n in _CB_KEYS.items()}).alias("ranks"),
        _map(
            {
                "construcao": exact_round(C("score_con") / whole * 100, 0),
                "defesa": exact_round(C("score_def") / whole * 100, 0),
            }
        ).alias("profile_shares"),
        C("perfil").alias("profile"),
        C("hybrid_lean"),
        _cluster(
            "zagueiros",
            "cluster_construtor_badge",
            {k: f"cluster_share_{k}" for k in arch},
            {k: f"nota_{k}" for k in arch},
        ).alias("cluster"),
        _tendencies(rated).alias("tendencies"),
        _scatter_sources(rated).alias("shown"),
    )


_CB_KEYS = {"geral": "geral", "construcao": "construcao", "defesa": "defesa", "perfil": "perfil"}


def scatter_map() -> Column:
    """Scatter metrics of the row's family; tendency metrics come from the rating card."""
    choices = {}
    for f, family in config.FAMILIES.items():
        choices[f] = _map(
            {
                k: F.coalesce(F.try_element_at(C("shown"), F.lit(v)), F.lit(0.0))
                if v.startswith("n_")
                else F.coalesce(C(v).cast("double"), F.lit(0.0))
                for k, v in family.scatter.items()
            }
        )
    return by_family(choices)


def dossiers(people: DataFrame, cards: DataFrame, enrichment: DataFrame | None = None) -> DataFrame:
    """One document per player. ``people`` carries the aspect columns, ``cards`` the ratings.

    ``enrichment`` may bring a ``transfermarkt`` struct per player id.
    """
    profiles = by_family({f: F.array(*[F.lit(p) for p in x.profiles]) for f, x in config.FAMILIES.items()})
    joined = people.drop("perfil").join(cards, "player_id")
    if enrichment is not None:
        joined = joined.join(enrichment.select("player_id", "transfermarkt"), "player_id", "left")
    else:
        joined = joined.withColumn("transfermarkt", F.lit(None).cast("string"))
    return joined.select(
        "player_id",
        "name",
        "club",
        "label",
        "position",
        C("family").alias("position_family"),
        "nationality",
        C("birth_year").cast("int").alias("birth_year"),
        C("height").cast("int").alias("height"),
        "foot",
        C("minutes").cast("int").alias("minutes"),
        exact_round(C("minutes_share") * 100, 1).alias("minutes_pct"),
        C("goals").cast("int").alias("goals"),
        C("assists").cast("int").alias("assists"),
        "rating",
        "ratings",
        "ranks",
        "profile",
        "profile_shares",
        "tendencies",
        F.struct(*[e.alias(n) for n, e in aspect_groups().items()]).alias("aspects"),
        profiles.alias("profiles_available"),
        scatter_map().alias("scatter"),
        "hybrid_lean",
        "cluster",
        "transfermarkt",
    )


def build_generic(people: DataFrame) -> DataFrame:
    """Dossiers of the families with profile indices."""
    chosen = settle(people.where(C("family").isin(*config.GENERIC_FAMILIES)), "people")
    return dossiers(with_aspects(chosen), generic_cards(settle(rate_families(chosen), "rated")))


def build_all(people: DataFrame, history: DataFrame, enrichment: DataFrame | None = None) -> DataFrame:
    """Dossiers of all six families."""
    from ..operators.clusters import with_two_axis_profile
    from .centrebacks import rate_centrebacks
    from .fullbacks import rate_fullbacks

    people = settle(people, "people")
    backs = settle(rate_centrebacks(people, history), "cb-rated")
    axes = with_two_axis_profile(backs).select("player_id", "score_con", "score_def", "hybrid_lean")
    cards = (
        generic_cards(rate_families(people))
        .unionByName(fullback_cards(rate_fullbacks(people)))
        .unionByName(centreback_cards(backs.join(axes, "player_id")))
    )
    return dossiers(with_aspects(people), settle(cards, "cards"), enrichment)
