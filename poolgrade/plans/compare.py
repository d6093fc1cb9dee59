"""Head-to-head comparison and scatter projections over the dossiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..operators.matching import block_join

C = F.col
ASPECT_GROUPS = ("defensivos", "construcao", "perfil_construcao", "perfil_defensivo", "ofensivos", "terco_final")


def comparison_cards(docs: DataFrame) -> DataFrame:
    """One row per player with the comparable figures as maps."""
    rows = {
        f: F.map_from_arrays(
            F.array(*[F.lit(k) for k, _ in items]),
            F.array(*[F.coalesce(F.try_element_at(C("ratings"), F.lit(k)), F.lit(0.0)) for k, _ in items]),
        )
        for f, items in config.PROFILE_ROWS.items()
    }
    own = C("position_family")
    profile = None
    for f, expr in rows.items():
        profile = F.when(own == f, expr) if profile is None else profile.when(own == f, expr)
    shares = None
    for f, items in config.PROFILE_ROWS.items():
        expr = F.map_from_arrays(
            F.array(*[F.lit(k) for k, _ in items]),
            F.array(*[F.coalesce(F.try_element_at(C("profile_shares"), F.lit(k)), F.lit(0.0)) for k, _ in items]),
        )
        shares = F.when(own == f, expr) if shares is None else shares.when(own == f, expr)
    tendencies = F.map_from_arrays(
        F.array(*[F.lit(t) for t in config.TENDENCIES]), F.array(*[C(f"tendencies.{t}") for t in config.TENDENCIES])
    )
    items = F.concat(*[_aspect_entries(g) for g in ASPECT_GROUPS])
    return docs.select(
        "player_id",
        "position_family",
        C("ratings")["geral"].alias("geral"),
        profile.alias("profiles"),
        shares.alias("shares"),
        tendencies.alias("tendencies"),
        F.map_from_entries(items).alias("aspects"),
        "cluster",
    )


def _aspect_entries(group: str) -> Column:
    """(group|label, percentile) of each aspect of a group; a missing group has none."""
    held = F.coalesce(C(f"aspects.{group}"), F.slice(C("aspects.defensivos"), 1, 0))
    return F.transform(
        held, lambda a: F.struct(F.concat_ws("|", F.lit(group), a["label"]).alias("k"), a["percentile"].alias("v"))
    )


def paired(pairs: DataFrame, cards: DataFrame) -> DataFrame:
    """Both cards next to each (id_a, id_b); an id that many pairs share is split over tasks."""
    pairs = pairs.select("id_a", "id_b").distinct().withColumn("pair", F.xxhash64("id_a", "id_b"))
    body = [c for c in cards.columns if c != "player_id"]
    side_a = cards.select(C("player_id").alias("id_a"), F.struct(*body).alias("a"))
    side_b = cards.select(C("player_id").alias("id_b"), F.struct(*body).alias("b"))
    half = block_join(side_a, pairs, ["id_a"], "pair", "id_a")
    return block_join(side_b, half, ["id_b"], "pair", "id_b")


def _metric_rows(name: str, both: bool, missing: float) -> Column:
    """(kind, key, a, b) for a map column; keys of one side only are kept unless ``both``."""
    a, b = C(f"a.{name}"), C(f"b.{name}")
    keys = F.array_intersect(F.map_keys(a), F.map_keys(b)) if both else F.array_union(F.map_keys(a), F.map_keys(b))
    return F.transform(
        keys,
        lambda k: F.struct(
            F.lit(name).alias("kind"),
            k.alias("key"),
            F.coalesce(F.try_element_at(a, k), F.lit(missing)).alias("value_a"),
            F.coalesce(F.try_element_at(b, k), F.lit(missing)).alias("value_b"),
        ),
    )


def leader(a: Column, b: Column) -> Column:
    return F.when(a == b, "tie").when(a > b, "a").otherwise("b")


def versus_metrics(pairs: DataFrame, cards: DataFrame) -> DataFrame:
    """Every compared figure of every pair with its leader and gap."""
    overall = F.array(
        F.struct(
            F.lit("rating").alias("kind"), F.lit("geral").alias("key"), C("a.geral").alias("value_a"),
            C("b.geral").alias("value_b"),
        )
    )
    rows = F.concat(
        overall,
        _metric_rows("profiles", False, 0.0),
        _metric_rows("tendencies", False, 0.0),
        _metric_rows("aspects", True, -1.0),
    )
    out = paired(pairs, cards).select("id_a", "id_b", F.explode(rows).alias("m")).select("id_a", "id_b", "m.*")
    return out.withColumns(
        {"gap": C("value_a") - C("value_b"), "leads": leader(C("value_a"), C("value_b"))}
    )


def verdict(metrics: DataFrame) -> DataFrame:
    """Wins of each side and the number of figures per pair."""
    return metrics.groupBy("id_a", "id_b").agg(
        F.count_if(C("gap") > 0).alias("wins_a"),
        F.count_if(C("gap") < 0).alias("wins_b"),
        F.count(F.lit(1)).alias("total"),
    )


def aspect_table(pairs: DataFrame, cards: DataFrame) -> DataFrame:
    """Aspects of both sides matched by group and label; a missing side scores -1."""
    rows = paired(pairs, cards).select("id_a", "id_b", F.explode(_metric_rows("aspects", False, -1.0)).alias("m"))
    return rows.select(
        "id_a",
        "id_b",
        F.substring_index("m.key", "|", 1).alias("aspect_group"),
        F.substring_index("m.key", "|", -1).alias("label"),
        "m.value_a",
        "m.value_b",
        leader(C("m.value_a"), C("m.value_b")).alias("leads"),
    )


def share_table(pairs: DataFrame, cards: DataFrame) -> DataFrame:
    """Profile shares of both sides, without rows where both are 0."""
    rows = paired(pairs, cards).select("id_a", "id_b", F.explode(_metric_rows("shares", False, 0.0)).alias("m"))
    return rows.select("id_a", "id_b", "m.key", "m.value_a", "m.value_b").where(
        (C("value_a") > 0) | (C("value_b") > 0)
    )


def archetype_table(pairs: DataFrame, cards: DataFrame) -> DataFrame:
    """Share and rating per archetype of two players whose clusters are of the same family."""
    both = paired(pairs, cards).where(C("a.cluster.family") == C("b.cluster.family"))
    keys = F.map_keys(C("a.cluster.shares"))
    return both.select("id_a", "id_b", F.explode(keys).alias("key"), "a", "b").select(
        "id_a",
        "id_b",
        "key",
        *[
            F.try_element_at(C(f"{side}.cluster.{part}"), C("key")).alias(f"{part[:-1]}_{side}")
            for part in ("shares", "ratings")
            for side in ("a", "b")
        ],
    ).withColumns(
        {
            "share_leads": leader(C("share_a"), C("share_b")),
            "rating_leads": leader(C("rating_a"), C("rating_b")),
        }
    )


def scatter_points(docs: DataFrame, x: str, y: str, highlight: tuple[str, str] = ("", "")) -> DataFrame:
    """Points of two scatter metrics with the means of the family; a missing metric is 0."""
    points = docs.select(
        "position_family",
        "player_id",
        "label",
        F.coalesce(F.try_element_at(C("scatter"), F.lit(x)), F.lit(0.0)).alias("x"),
        F.coalesce(F.try_element_at(C("scatter"), F.lit(y)), F.lit(0.0)).alias("y"),
        (C("player_id") == highlight[0]).alias("is_a"),
        (C("player_id") == highlight[1]).alias("is_b"),
    )
    means = points.groupBy("position_family").agg(F.avg("x").alias("avg_x"), F.avg("y").alias("avg_y"))
    return points.join(F.broadcast(means), "position_family")


def ordered_mix(cards: DataFrame) -> DataFrame:
    """Archetype rows of a player: the own archetype first, the others by share."""
    slug = F.translate(F.lower(C("cluster.archetype")), "áéíóúãç ", "aeiouac_")
    slug = F.replace(slug, F.lit("defensor_de_area"), F.lit("defensor_area"))
    entries = F.transform(
        F.map_entries("cluster.shares"),
        lambda e: F.struct(
            (-(e["key"] == slug).cast("int")).alias("turn"), (-e["value"]).alias("order"), e["key"].alias("key")
        ),
    )
    return cards.where(C("cluster").isNotNull()).select(
        "player_id", F.posexplode(F.array_sort(entries)).alias("place", "e")
    ).select("player_id", "place", "e.key", (-C("e.order")).alias("share"))
