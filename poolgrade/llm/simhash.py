"""Near duplicates by SimHash fingerprints, found with multi-index hashing.

A 64-bit fingerprint has two 32-bit segments. Two fingerprints that differ in at most four bits differ
in at most two bits of one segment, and then some value lies within one bit of both segments. Each
fingerprint therefore enters the tables under the 33 values of the small Hamming ball around each
segment; table matches are verified on the complete distance.

Matches are not listed pair by pair: inside a table entry a search spreads from fingerprint to fingerprint
and returns a star per connected group, which loses no connection. An entry with more than ``ENTRY``
fingerprints is dealt anew by balls around the halves of its other segment, and once more by quarters;
after that an entry cannot exceed 33 x 17 x 9 x 256 fingerprints.

Null texts and texts without words have fingerprint zero and are linked like any other. Copies share a
fingerprint and are one node, however many there are.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import bounded_batches, with_results, written
from .graph import components

WORDS = 4
SEED = 42
DISTANCE = 4  # the ball radii follow from it: one bit on both sides finds two, two segments find four
ENTRY = 4096


def fingerprint(texts: list[bytes | None], words: int = WORDS) -> np.ndarray:
    """Unsigned fingerprints of UTF-8 texts."""
    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    counts = []
    for text in texts:
        parts = text.lower().split() if text else []
        if not parts:
            counts.append(0)
            continue
        line = b" ".join(parts)
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        n = max(1, len(parts) - words + 1)
        starts = [0, *(ends[: n - 1] + 1).tolist()]
        hashes += [digest(line[a:b], SEED) for a, b in zip(starts, ends[-n:].tolist())]
        counts.append(n)
    counts = np.array(counts, np.int64)
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        edges = np.concatenate([[0], np.cumsum(counts[some])])
        sums = np.stack([bits[a:b].sum(axis=0, dtype=np.int64) for a, b in pairwise(edges.tolist())])
        out[some] = np.packbits(2 * sums > counts[some][:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


FIELDS = T.StructType([T.StructField("bits", T.LongType())])


def fingerprints(df: DataFrame, text: str = "text", column: str = "simhash", words: int = WORDS) -> DataFrame:
    """``df`` with a struct ``column`` whose ``bits`` is the fingerprint as a signed long."""

    def judge():
        return lambda texts: [fingerprint(texts, words).view(np.int64)]

    return with_results(df, text, FIELDS, judge, column, given="bytes")


def _balls(value, width: int):
    """Column with the value and all values one bit away from it."""
    masks = F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(width)])
    return F.transform(masks, lambda m: value.bitwiseXOR(m))


WIDTHS = (32, 16, 8)


def _entries(df: DataFrame, level: int) -> DataFrame:
    """Table entries: ``df`` (fp, keys so far) under the balls of the two halves of the bits not keyed yet.

    A key holds the segment's value and, above it, which of the two segments it is.
    """
    width = WIDTHS[level]
    start = "0"  # where the bits that no key holds begin
    for n in range(level):
        start += f" + {WIDTHS[n]} * (1 - shiftrightunsigned(k{n}, {WIDTHS[n]}))"
    sides = []
    for side in (0, 1):
        value = F.expr(f"shiftrightunsigned(fp, cast({start} + {side * width} as int)) & {(1 << width) - 1}L")
        key = F.explode(_balls(value + F.lit(side << width).cast("long"), width)).alias(f"k{level}")
        sides.append(df.select(*df.columns, key))
    return sides[0].unionByName(sides[1])


def groups(values: np.ndarray, distance: int) -> list[np.ndarray]:
    """Connected groups of distinct fingerprints under the distance; each search step is one numpy pass."""
    left = np.sort(values)
    out = []
    while len(left):
        found = [left[:1]]
        left, queue = left[1:], [left[0]]
        while queue and len(left):
            near = np.bitwise_count(left ^ queue.pop()) <= distance
            if near.any():
                found.append(left[near])
                queue.extend(left[near])
                left = left[~near]
        out.append(np.concatenate(found))
    return out


def _match(keys: list[str], most: int | None, distance: int):
    """Reader of entries sorted by key: stars of connected fingerprints, and the rows of entries too large."""

    def close(fps: np.ndarray, key: dict):
        if most is not None and len(fps) > most:
            n = len(fps)
            return fps, np.zeros(n, np.int64), np.ones(n, bool), {k: np.full(n, v) for k, v in key.items()}
        stars = [(g[1:], np.full(len(g) - 1, g.min())) for g in groups(fps, distance) if len(g) > 1]
        if not stars:
            return None
        a, b = (np.concatenate(x) for x in zip(*stars))
        return a, b.view(np.int64), np.zeros(len(a), bool), {k: np.full(len(a), v) for k, v in key.items()}

    def batch(parts):
        cols = [np.concatenate([p[i] for p in parts]) for i in range(3)]
        extra = [np.concatenate([p[3][k] for p in parts]) for k in keys]
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[0].view(np.int64)), pa.array(cols[1]), pa.array(cols[2]), *map(pa.array, extra)],
            names=["fp", "root", "large", *keys],
        )

    def run(batches):
        held: list[np.ndarray] = []  # fingerprints of the entry that may go on in the next batch
        held_key = None
        for rows in batches:
            if not rows.num_rows:
                continue
            cols = [rows.column(k).to_numpy() for k in keys]
            fps = rows.column("fp").to_numpy().view(np.uint64)
            new = np.zeros(len(fps), bool)
            new[0] = True
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], len(fps))
            out = []
            # pairs are most of the entries with a match: one pass for all
            whole = slice(1, len(starts) - 1)
            two = starts[whole][ends[whole] - starts[whole] == 2]
            two = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= distance]
            if len(two):
                low, high = np.minimum(fps[two], fps[two + 1]), np.maximum(fps[two], fps[two + 1])
                out.append((high, low.view(np.int64), np.zeros(len(two), bool), {k: c[two] for k, c in zip(keys, cols)}))
            edge = {0, len(starts) - 1}
            for n in sorted(edge | set(np.flatnonzero(ends - starts > 2).tolist())):
                key = {k: c[starts[n]] for k, c in zip(keys, cols)}
                part = fps[starts[n] : ends[n]]
                if n not in edge:
                    done = close(part, key)
                    out += [done] if done else []
                    continue
                if held and key == held_key:
                    held.append(part)
                else:
                    if held:
                        done = close(np.concatenate(held), held_key)
                        out += [done] if done else []
                    held, held_key = [part], key
            if out:
                yield batch(out)
        if held:
            done = close(np.concatenate(held), held_key)
            if done:
                yield batch([done])

    return run


def links(fps: DataFrame, fp: str = "fp", distance: int = DISTANCE, entry: int = ENTRY) -> DataFrame:
    """(fp, root) edges that connect all distinct fingerprints linked by a chain of small distances."""
    if distance > 4:
        raise ValueError("two segments with balls of one bit on both sides cover at most four bits")
    spark = fps.sparkSession
    bounded_batches(spark)
    left = fps.select(F.col(fp).alias("fp"))
    found = []
    for level in range(len(WIDTHS)):
        keys = [f"k{n}" for n in range(level + 1)]
        # the Arrow batches of a sorted partition keep its order
        dealt = _entries(left, level).repartition(*keys).sortWithinPartitions(*keys)
        most = entry if level + 1 < len(WIDTHS) else None
        schema = "fp long, root long, large boolean, " + ", ".join(f"{k} long" for k in keys)
        marked = written(dealt.mapInArrow(_match(keys, most, distance), schema), f"matches{level}")
        found.append(marked.where("NOT large").select("fp", "root"))
        left = marked.where("large").drop("root", "large")
        if left.isEmpty():
            break
    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    return edges.distinct()


def clustered(df: DataFrame, doc_id: str, bits: str, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, bits, component): the least id among all documents reached through small distances."""
    docs = df.select(F.col(doc_id).alias("doc_id"), F.col(bits).alias("bits"))
    nodes = written(docs.groupBy("bits").agg(F.min("doc_id").alias("first")), "fingerprints")
    roots = components(links(nodes, "bits", distance), "fp", "root")
    named = nodes.join(roots, nodes.bits == roots.node, "left").withColumn("root", F.coalesce("root", "bits"))
    least = named.groupBy("root").agg(F.min("first").alias("component"))
    place = named.join(least, "root").select(F.col("bits").alias("at"), "component")
    return docs.join(place, docs.bits == place["at"], "left").drop("at")
