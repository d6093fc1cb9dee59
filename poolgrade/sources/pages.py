"""Links of raw pages: the first non-empty label per target and page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINK = r'<a[^>]*href="/([^"?]+)"[^>]*>([^<]*)</a>'


def links(pages: DataFrame, key: str, html: str, pattern: str = LINK) -> DataFrame:
    """(key, id, label) for every link; group 1 of the pattern is the id, group 2 the label."""
    found = F.arrays_zip(
        F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(1)).alias("id"),
        F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(2)).alias("label"),
    )
    items = pages.select(key, F.posexplode(found).alias("pos", "item")).select(
        key, "pos", F.col("item.id").alias("id"), F.trim("item.label").alias("label")
    )
    return items.where(F.col("label") != "").groupBy(key, "id").agg(F.min_by("label", "pos").alias("label"))
