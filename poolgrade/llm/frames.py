"""Helpers shared by the operators: bounded Arrow batches, added columns, the shared folder."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20
SLICE_BYTES = 1 << 21
"""Text bytes a row function sees at once; a longer text comes alone."""


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 1,000 rows and 16 MB (one row may be larger), so that long texts fit.

    Python workers also get this project's folder as a module path, for sessions that did not ship it.
    """
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    for key, value in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        spark.conf.set(f"spark.sql.execution.arrow.{key}", str(value))


def fresh(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores until no column of ``df`` has that name in any letter case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def give_back() -> None:
    """Return freed memory to the system at the end of a task: the worker lives on for other operators' tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def without(df: DataFrame, column: str) -> DataFrame:
    """``df`` without the columns of that name in any letter case."""
    return df.drop(*[c for c in df.columns if c.lower() == column.lower()])


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Consecutive parts of a text column, each of about ``most`` bytes at most (one text may be longer)."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 100
    part = np.cumsum(size) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    for a, b in zip(cuts, cuts[1:]):
        if a < b:
            yield texts.slice(a, b - a)


def with_results(
    df: DataFrame,
    text: str,
    fields: T.StructType,
    judge: Callable[[], Callable[[list], list]],
    column: str,
    given: str = "str",
    most: int = SLICE_BYTES,
) -> DataFrame:
    """``df`` with a struct ``column`` that ``judge()(texts)`` computes from the text column.

    ``judge`` is called once per task and returns a function from some texts to one list of values per
    field, for slices of about ``most`` bytes. ``given`` says how it gets them: a list of "str" or of UTF-8 "bytes", None for null, or an
    "arrow" array. All other columns pass through as they are, but one that is called ``column`` gives way.
    """
    bounded_batches(df.sparkSession)
    df = without(df, column)
    names = df.columns
    at = names.index(text)
    kinds = [(f.name, to_arrow_type(f.dataType)) for f in fields]
    struct = pa.struct([pa.field(n, k) for n, k in kinds])

    def run(batches):
        rate = judge()
        for batch in batches:
            done = 0
            for texts in slices(batch.column(at), most):
                if given == "bytes":
                    values = rate(texts.cast(pa.binary()).to_pylist())
                else:
                    values = rate(texts if given == "arrow" else texts.to_pylist())
                values = [pa.array(v, type=k) for v, (_, k) in zip(values, kinds, strict=True)]
                part = pa.StructArray.from_arrays(values, fields=list(struct))
                yield pa.RecordBatch.from_arrays([*batch.slice(done, len(texts)).columns, part], names=[*names, column])
                done += len(texts)
        give_back()

    schema = T.StructType([*df.schema.fields, T.StructField(column, fields)])
    return df.mapInArrow(run, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all executors reach.

    Only a local session without that setting gets one of its own, inside the warehouse folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    return f"{spark.conf.get('spark.sql.warehouse.dir')}/shared"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_with(df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, dict]:
    """`written`, and aggregates of the rows observed on the way."""
    seen = Observation()
    out = written(df.observe(seen, *[c.alias(k) for k, c in measures.items()]), name)
    return out, seen.get


def remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``: the split into training and held-out rows."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts
