"""Quality by the votes of the nearest labelled documents in a latent-semantic space.

A text's terms say how it is written: the shape of each word (capitals, small letters, digits, runs of marks), pairs
of neighbouring shapes, and words that repeat the word before them. Term weights use document frequencies over
all documents. A truncated singular value decomposition of labelled documents gives the latent space; the labelled
vectors, whose number is bounded, go to every task, which computes all cosines in blocks. The nearest vote with a
weight that falls with the angle; voters as near as the last of them vote too. A word of more than 64 characters
counts as its consecutive pieces of 64. Repeated rows get equal scores.

Texts without words have the zero vector and get the share of good labels. Without training rows all scores are 0.5.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import bounded_batches, slices, with_results
from .samples import labelled
from .words import byte_table, split_words

TERMS = 1 << 10
LATENT = 48
SAMPLE = 4000  # labelled vectors that vote, and that the space is fitted on
NEAREST = 25
WIDTH = 0.05  # of the weight's fall with 1 - cosine
BLOCK = 512  # documents compared at a time
PIECE = 64  # characters

WORDS = byte_table("".join(map(chr, range(0x21, 0x7F))), False)
SCORE = T.StructType([T.StructField("score", T.DoubleType())])
_RUN = re.compile(r"(.)\1+")


def shape(word: str) -> int:
    """A number for how a word is written: kinds of characters, with runs cut to one."""
    kinds = "".join("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in word)
    return zlib.crc32(_RUN.sub(r"\1", kinds).encode())


def piece_shapes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The shapes of all words' pieces in a row, and how many pieces each word has."""
    sizes = np.fromiter((-(-len(w) // PIECE) for w in words), np.int64, len(words))  # the empty word has none
    return np.array([shape(w[k : k + PIECE]) for w in words for k in range(0, len(w), PIECE)], np.int64), sizes


def term_counts(texts: pa.Array) -> np.ndarray:
    """One row per text: counts of its hashed shapes, shape pairs and repeats."""
    codes, edges, words = split_words(texts, WORDS)
    n = len(texts)
    owner = np.repeat(np.arange(n), np.diff(edges)) * TERMS
    again = (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])
    repeats = owner[1:][again] + 1
    shapes = np.zeros(0, np.int64)
    if len(codes):
        known, sizes = piece_shapes(words)
        first = np.cumsum(sizes) - sizes
        if sizes.max() > 1:
            counts = sizes[codes]
            begin = np.cumsum(counts) - counts
            at = np.repeat(first[codes] - begin, counts) + np.arange(counts.sum())
            shapes, owner = known[at], np.repeat(owner, counts)
        else:
            shapes = known[first[codes]]
    same = owner[1:] == owner[:-1]
    pairs = (shapes[:-1] * 31 + shapes[1:] * 17 + 5)[same]
    places = [owner + shapes % TERMS, owner[1:][same] + pairs % TERMS, repeats]
    return np.bincount(np.concatenate(places), minlength=n * TERMS).reshape(n, TERMS)


def document_frequencies(df: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """In how many of all texts each term stands, and the number of texts; one row per task and term is shuffled."""
    bounded_batches(df.sparkSession)

    def run(batches):
        total, n = np.zeros(TERMS, np.int64), 0
        for batch in batches:
            for part in slices(batch.column(0)):
                total += (term_counts(part) > 0).sum(axis=0)
                n += len(part)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, TERMS)), pa.array(np.concatenate([[n], total]))], names=["t", "n"])

    rows = df.select(F.col(text)).mapInArrow(run, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).collect()
    counts = {r["t"]: r["n"] for r in rows}
    return np.array([counts.get(t, 0) for t in range(TERMS)], float), counts.get(-1, 0)


class Voters:
    """The latent space and the labelled vectors in it."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, frequency: np.ndarray, n: int):
        self.idf = np.log((1 + n) / (1 + frequency)) + 1
        x = self.weighted(counts)
        values, vectors = np.linalg.eigh(x.T @ x)
        self.space = vectors[:, ::-1][:, :LATENT].astype(np.float32)
        self.vectors = self.latent(counts)
        self.labels = labels.astype(np.float32)
        self.prior = float(labels.mean())

    def weighted(self, counts: np.ndarray) -> np.ndarray:
        x = np.sqrt(counts / np.maximum(1, counts.sum(axis=1, keepdims=True))) * self.idf
        return (x / np.maximum(1e-12, np.linalg.norm(x, axis=1, keepdims=True))).astype(np.float32)

    def latent(self, counts: np.ndarray) -> np.ndarray:
        z = self.weighted(counts) @ self.space
        return z / np.maximum(1e-9, np.linalg.norm(z, axis=1, keepdims=True))

    def score(self, texts: pa.Array) -> list:
        out = np.empty(len(texts))
        for start in range(0, len(texts), BLOCK):
            counts = term_counts(texts.slice(start, BLOCK))
            cosines = self.latent(counts) @ self.vectors.T
            k = min(NEAREST, cosines.shape[1])
            last = np.partition(cosines, -k, axis=1)[:, -k]
            # all that are as near as the last one vote, so ties are not cut
            weight = np.exp((cosines - 1) / WIDTH) * (cosines >= last[:, None])
            votes = weight @ self.labels / np.maximum(1e-30, weight.sum(axis=1))
            out[start : start + len(votes)] = np.where(counts.any(axis=1), votes, self.prior)
        return [np.clip(out, 0, 1)]


def fit(
    docs: DataFrame, labels: DataFrame, train: Column, label: str = "quality", sample: int = SAMPLE
) -> Voters | None:
    """Document frequencies over all documents; voters from a sample of the labelled ones for which ``train`` holds."""
    frequency, n = document_frequencies(docs)
    rows = labelled(docs, labels, label, train, sample)
    field = T.StructType([T.StructField("x", T.BinaryType())])
    judge = lambda: lambda texts: [[r.tobytes() for r in term_counts(texts).astype("<u4")]]
    got = with_results(rows, "text", field, judge, "terms", given="arrow").select("doc_id", "label", "terms.x").collect()
    if not got:
        return None
    got.sort(key=lambda r: (r["doc_id"], bytes(r["x"])))
    counts = np.stack([np.frombuffer(r["x"], "<u4") for r in got]).astype(np.int64)
    return Voters(counts, np.array([r["label"] for r in got], float), frequency, n)


def scored(df: DataFrame, voters: Voters | None, text: str = "text", column: str = "quality") -> DataFrame:
    """``df`` with a struct whose ``score`` is the weighted share of good labels among the nearest."""
    if voters is None:
        return with_results(df, text, SCORE, lambda: lambda texts: [[0.5] * len(texts)], column, given="arrow")
    shared = df.sparkSession.sparkContext.broadcast(voters)
    return with_results(df, text, SCORE, lambda: shared.value.score, column, given="arrow")
