"""The registered queries: every operator bound to the given tables, with its SQL counterpart."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

MODULES = (
    "ingest",
    "pool_ranks",
    "ratings",
    "backs",
    "documents",
    "search",
    "joins",
    "matching",
    "clusters",
)


@dataclass(frozen=True)
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    covers: str
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register ``fn(spark, folder)`` under ``name``; ``covers`` lists the inventory rows it runs."""

    def keep(fn):
        if name in REGISTRY:
            raise ValueError(f"{name} is registered twice")
        REGISTRY[name] = Entry(fn, covers, sql)
        return fn

    return keep


def load() -> dict[str, Entry]:
    for module in MODULES:
        importlib.import_module(f"{__name__}.{module}")
    return REGISTRY
