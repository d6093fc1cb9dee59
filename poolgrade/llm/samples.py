"""Bounded samples of labelled rows for the classifiers, and small numeric helpers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAIN = 1 << 30


def sampled(rows: DataFrame, key: Column, most: int, by: str | None = None) -> DataFrame:
    """About ``most`` rows (of each value of ``by``), chosen by a hash of ``key``: the same in every run.

    All rows are counted first; of N rows each is taken with probability most / N. ``by`` must have few values.
    """
    draw = F.pmod(F.xxhash64(key, F.lit("draw")), F.lit(GRAIN))
    if by is None:
        count = rows.count()
        return rows.where(draw < int(min(1.0, most / max(1, count)) * GRAIN))
    counts = {r[by]: r["count"] for r in rows.groupBy(by).count().collect()}
    chosen = F.lit(False)
    for value, count in counts.items():
        chosen = chosen | ((F.col(by) == F.lit(value)) & (draw < int(min(1.0, most / count) * GRAIN)))
    return rows.where(chosen)


def labelled(docs: DataFrame, labels: DataFrame, label: str, train: Column, most: int) -> DataFrame:
    """(doc_id, text, label) of a sample of about ``most`` labelled documents; of repeated labels the greatest counts.

    Only the sampled ids, whose number is bounded, are broadcast; texts are not shuffled.
    """
    known = labels.where(F.col(label).isNotNull() & train).groupBy("doc_id").agg(F.max(label).alias("label"))
    ids = sampled(known, F.col("doc_id"), most)
    return docs.where("doc_id IS NOT NULL").select("doc_id", "text").join(F.broadcast(ids), "doc_id")


def logistic(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))
