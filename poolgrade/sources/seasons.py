"""Season sheets: one file set per season and league, told apart by the file name."""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import league_of, season_of
from ..session import scratch_dir, settle


def season_scan(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """All season files in one scan, tagged with season and league."""
    df = spark.read.option("recursiveFileLookup", True).parquet(*paths).withColumn("_file", F.input_file_name())
    # one row per file: the text rules read a file's name once, not once for each of its rows
    folder = F.regexp_extract(F.try_url_decode("_file"), r"([^/]+)/[^/]+$", 1)
    files = settle(df.select("_file").distinct(), "season-files")
    files = files.withColumns({"season": season_of(folder), "league": league_of(folder)})
    return df.join(F.broadcast(files), "_file").drop("_file")


def union_seasons(frames: Sequence[DataFrame]) -> DataFrame:
    """Season frames stacked by column name; columns missing in a season are null."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def write_season_files(df: DataFrame, season: str, league: str) -> list[str]:
    """Write one folder "Serie <league> <season>" per season and league, in one pass."""
    root = os.path.join(scratch_dir(df.sparkSession), "poolgrade", f"seasons-{uuid.uuid4().hex}")
    label = F.concat(F.lit("Serie "), F.col(league), F.lit(" "), F.col(season).cast("string"))
    df.withColumn("sheet", label).drop(season, league).write.partitionBy("sheet").parquet(root)
    return [root]
