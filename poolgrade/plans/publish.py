"""Site outputs: the index, the meta document and the written datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..operators.stats import facet_values, filter_bounds

C = F.col
INDEX_FIELDS = (
    "player_id",
    "name",
    "club",
    "label",
    "position",
    "position_family",
    "nationality",
    "birth_year",
    "height",
    "foot",
    "minutes",
    "minutes_pct",
    "rating",
    "profile",
    "hybrid_lean",
    "cluster",
    "transfermarkt",
)
# What the meta document and the facets read of the people.
META_FIELDS = ("position", "height", "minutes", "birth_year", "club", "nationality")


def player_index(docs: DataFrame) -> DataFrame:
    return docs.select(*INDEX_FIELDS)


def site_meta(docs: DataFrame, people: DataFrame, source: str, league: str, season: str) -> DataFrame:
    """One row: counts per family, filter bounds and the scatter catalogue.

    Bounds come from all outfield rows, counts from the rated ones. The facets are a table of their own.
    """
    counts = docs.groupBy().agg(
        F.count(F.lit(1)).alias("player_count"),
        F.struct(
            *[F.count_if(C("position_family") == f).alias(f.replace("-", "_")) for f in config.FAMILIES]
        ).alias("_counts"),
        F.bround(F.min("rating"), 1).alias("_low"),
        F.bround(F.max("rating"), 1).alias("_high"),
    )
    bounds = filter_bounds(people.withColumn("rating", F.lit(0.0)))
    one = F.lit(1).alias("_one")
    joined = counts.select("*", one).join(bounds.select("*", one), "_one")
    families = F.array(
        *[
            F.struct(
                F.lit(f).alias("key"),
                F.lit(x.label).alias("label"),
                F.array(*[F.lit(p) for p in x.positions]).alias("positions"),
                F.array(*[F.lit(p) for p in x.profiles]).alias("profiles"),
                C("_counts")[f.replace("-", "_")].alias("count"),
            )
            for f, x in config.FAMILIES.items()
        ]
    )
    metrics = F.struct(
        *[
            F.array(
                *[
                    F.struct(
                        F.lit(k).alias("key"), F.lit(config.SCATTER_LABELS[k]).alias("label"), F.lit(v).alias("field")
                    )
                    for k, v in x.scatter.items()
                ]
            ).alias(f)
            for f, x in config.FAMILIES.items()
        ]
    )
    return joined.select(
        F.lit(league).alias("league"),
        F.lit(season).alias("season"),
        F.lit(source).alias("source"),
        "player_count",
        families.alias("families"),
        F.struct(
            F.array("height_min", "height_max").alias("height"),
            F.array("minutes_min", "minutes_max").alias("minutes"),
            F.array("birth_min", "birth_max").alias("birth_year"),
            F.array("_low", "_high").alias("rating"),
        ).alias("filters"),
        metrics.alias("scatter_metrics"),
    )


def site_facets(people: DataFrame) -> DataFrame:
    """The values of the club and nationality filters, one row each."""
    return facet_values(people, ["club", "nationality"])


def write_site(docs: DataFrame, meta: DataFrame, facets: DataFrame, folder: str) -> dict[str, str]:
    """Index, dossiers (a folder per family, read by key), meta and facets as JSON datasets."""
    paths = {n: f"{folder.rstrip('/')}/{n}" for n in ("players", "dossiers", "meta", "facets")}
    facets.write.json(paths["facets"])
    player_index(docs).write.json(paths["players"])
    docs.write.partitionBy("position_family").json(paths["dossiers"])
    meta.write.json(paths["meta"])
    return paths


def write_study(df: DataFrame, path: str, places: int = 2) -> str:
    """Study rows as CSV with fixed decimals."""
    cells = [
        F.format_string(f"%.{places}f", C(c)).alias(c) if t == "double" else C(c) for c, t in df.dtypes
    ]
    df.select(*cells).write.option("header", True).csv(path)
    return path
