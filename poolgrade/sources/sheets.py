"""Stat sheets with loose headings, and stored documents."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config
from ..functions.scalar import number
from ..operators.identity import position_of, with_identity, with_row_index
from ..session import scratch_dir, settle

HEADINGS = {**config.IDENTITY_HEADINGS, **config.BIO_HEADINGS, **config.STAT_HEADINGS}


def merge_duplicate_headings(df: DataFrame) -> DataFrame:
    """Fold ``x__1``, ``x__2`` ... (repeated headings) into ``x``, the leftmost value first."""
    groups: dict[str, list[str]] = {}
    for column in df.columns:
        groups.setdefault(re.sub(r"__\d+$", "", column), []).append(column)
    return df.select(*[F.coalesce(*[F.col(f"`{c}`") for c in cs]).alias(name) for name, cs in groups.items()])


def pick_heading(columns: Sequence[str], candidates: Sequence[str]) -> str | None:
    """The first candidate that exists."""
    return next((c for c in candidates if c in columns), None)


def resolve_headings(df: DataFrame, wanted: Sequence[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """One canonical column per known heading. Missing statistics become 0, other gaps stay null."""
    out = [F.col(k) for k in keep]
    for name in wanted or HEADINGS:
        found = pick_heading(df.columns, HEADINGS[name])
        if name == "club" and found is None:
            found = next((c for c in df.columns if c.lower().startswith("equip")), None)
        source = F.col(f"`{found}`") if found else F.lit(None).cast("string")
        if name in config.IDENTITY_HEADINGS:
            out.append(source.cast("string").alias(name))
        elif name == "minutes":
            out.append(number(source).cast("int").alias(name))
        elif name in config.BIO_HEADINGS:
            out.append(source.try_cast("double").cast("int").alias(name))
        else:
            out.append(number(source).alias(name))
    return df.select(*out)


def first_usable(
    sources: Sequence[tuple[str, DataFrame]], preferred_min: int = 1, alternate_min: int = config.MIN_ALTERNATE_ROWS
) -> tuple[DataFrame, str]:
    """The first source with enough rows; only the needed rows are counted."""
    for i, (name, df) in enumerate(sources):
        need = preferred_min if i == 0 else alternate_min
        if df.limit(need).count() >= need:
            return df, name
    raise FileNotFoundError("no usable source")


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A sheet as text columns; headings may repeat, so CSV headings are read as data."""
    if path.endswith(".csv"):
        head = spark.read.csv(path, header=False).first()
        seen: dict[str, int] = {}
        names = []
        for cell in head:
            count = seen.get(cell, 0)
            seen[cell] = count + 1
            names.append(cell if count == 0 else f"{cell}__{count}")
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        return spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)
    return spark.read.parquet(path)


def load_sheet(spark: SparkSession, sources: Sequence[tuple[str, str]]) -> DataFrame:
    """Typed sheet with identity columns from the first source that exists and has enough players."""
    found = []
    for name, path in sources:
        if _exists(spark, path):
            raw = merge_duplicate_headings(read_sheet(spark, path))
            found.append((name, resolve_headings(raw).where(position_of(F.col("position_raw")).isNotNull())))
    df, source = first_usable(found)
    df = settle(df.withColumn("_row", F.monotonically_increasing_id()), "sheet")
    order = [F.coalesce("name", F.lit("")), F.coalesce("club", F.lit("")), F.col("_row")]
    indexed = with_row_index(df, order, "_row")
    return with_identity(indexed, "row_index").drop("_row").withColumn("source", F.lit(source))


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def write_documents(df: DataFrame, family: str, path: str | None = None) -> str:
    """Documents as JSON, one folder per family."""
    path = path or os.path.join(scratch_dir(df.sparkSession), "poolgrade", f"documents-{uuid.uuid4().hex}")
    df.write.partitionBy(family).json(path)
    return path


def read_documents(spark: SparkSession, path: str, schema: T.StructType, family: str | None = None) -> DataFrame:
    """Stored documents; a family reads only its own folder."""
    docs = spark.read.schema(schema).json(path)
    return docs if family is None else docs.where(F.col("position_family") == family)
