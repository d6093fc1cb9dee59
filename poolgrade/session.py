"""Session defaults and the shared scratch folder used to cut long lineages."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # no call-site capture per expression, which wide projections feel
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own settings."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("poolgrade")
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


def workers(spark: SparkSession) -> None:
    """Python workers get this project's folder as a module path, for sessions that did not ship it."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[1]))


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; in local mode, without one, a folder of the warehouse."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    return os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "shared")


def settle(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    A frame that feeds several aggregates and joins is computed once this way. The copy survives
    executor loss, keeps column pruning, and gives the optimiser real sizes to plan joins with.
    """
    return settle_counted(df, name)[0]


def settle_counted(df: DataFrame, name: str = "stage") -> tuple[DataFrame, int]:
    """`settle`, and the number of rows, observed while writing."""
    out, seen = settle_measured(df, name, {"rows": F.count(F.lit(1))})
    return out, seen["rows"]


def settle_measured(df: DataFrame, name: str, measures: dict[str, Column]) -> tuple[DataFrame, dict]:
    """`settle`, and aggregates of the rows, observed while writing."""
    spark = df.sparkSession
    path = os.path.join(scratch_dir(spark), "poolgrade", f"{name}-{uuid.uuid4().hex}")
    seen = Observation()
    df.observe(seen, *[c.alias(k) for k, c in measures.items()]).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get


def release(spark: SparkSession) -> bool:
    """Delete the settled frames of this project in the shared folder, once their results are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(scratch_dir(spark), "poolgrade"))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
