"""Connected components of an edge table of any size, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import written_with


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Point neighbours at the least node around each centre.

    Large star: each larger neighbour of a centre. Small star: the centre and each smaller neighbour.
    """
    if large:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = around.groupBy("u").agg(F.min("v").alias("m"))
    least = least.withColumn("m", F.least("u", "m"))
    joined = around.join(least, "u")
    moved = joined.where(F.col("v") > F.col("u")) if large else joined
    out = moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root) for every node with an edge to another one; the root is the least node it reaches.

    Nodes are of any ordered type; loops, repeated edges and null ends count for nothing. Each round is
    written to the shared folder, and the rounds end when one changes nothing. Counts and a checksum are
    all that reaches the driver.
    """
    seen = {"n": F.count(F.lit(1)), "sum": F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))}
    start = edges.select(F.col(left).alias("u"), F.col(right).alias("v"))
    now, state = written_with(start.where("u <> v").distinct(), "edges", **seen)
    while state["n"]:
        now, after = written_with(_star(_star(now, True), False), "edges", **seen)
        if after == state:
            break
        state = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
