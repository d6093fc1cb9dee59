"""Toxicity by a factorization machine over hashed terms.

Terms are a text's lower-cased words and the first letters of its longer words, as 64-bit hashes. The terms that
the labels speak for or against most clearly are kept, and the machine learns a weight and a small vector for
each of them: the products of the vectors are the pairwise interactions, such as an insult together with the
mention of a group, that single weights cannot express. The score is a probability.

Null and empty texts have no terms and get the score of the bias. Without training rows all scores are 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import with_results, written
from .samples import labelled, logistic
from .words import byte_table, split_words

PREFIXES = (4, 5)
SAMPLE = 8000  # labelled documents that the machine is fitted on
MOST_TERMS = 8192
LEAST_DOCS = 5
CLEAR = 5.0  # standard errors between a term's shares in toxic and other documents
FACTORS = 8
ROUNDS = 20
BATCH = 128
RATE = 0.2
DECAY = 1e-4
KEEP = 0.3  # share of the terms that a round of the fit sees of every other document, so that each learns to count alone

LETTERS = byte_table("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", True)
SCORE = T.StructType([T.StructField("score", T.DoubleType())])


def word_terms(word: str) -> list[int]:
    """Hashes of a word and of its beginnings, as signed 64-bit numbers."""
    terms = [word, *("^" + word[:n] for n in PREFIXES if len(word) > n)]
    return [xxhash.xxh64_intdigest(t.encode()) - (1 << 63) for t in terms]


def present(texts: pa.Array, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text number, term) pairs without repeats, in order; only terms in the sorted ``known``, if given, as places in it."""
    codes, edges, words = split_words(texts, LETTERS)
    terms = [word_terms(w) for w in words]
    counts = np.fromiter(map(len, terms), np.int64, len(terms))
    flat = np.array([t for ts in terms for t in ts], np.int64)
    owner = np.repeat(np.arange(len(words)), counts)
    if known is not None:
        at = np.searchsorted(known, flat)
        at[at == len(known)] = 0
        there = known[at] == flat if len(known) else np.zeros(len(flat), bool)
        flat, owner = at[there], owner[there]
        counts = np.bincount(owner, minlength=len(words))
    starts = np.concatenate([[0], np.cumsum(counts)])
    text = np.repeat(np.arange(len(texts)), np.diff(edges))
    seen = np.flatnonzero(counts[codes])
    pairs = np.unique(text[seen] * len(words) + codes[seen]) if len(words) else np.zeros(0, np.int64)
    text, code = np.divmod(pairs, max(1, len(words)))
    n = counts[code]
    ends = np.cumsum(n)
    at = np.repeat(starts[code] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
    got = np.unique(np.stack([np.repeat(text, n), flat[at]], axis=1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
    return got[:, 0], got[:, 1]


class Machine:
    """score = logistic(bias + sum of weights + half of (square of summed vectors - summed squares))."""

    def __init__(self, known: np.ndarray, bias: float):
        draw = np.random.default_rng(7)
        self.known, self.bias = known, bias
        self.weight = np.zeros(len(known))
        self.vector = draw.normal(0, 0.02, (len(known), FACTORS))

    def raw(self, text: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        out = self.bias + np.bincount(text, self.weight[term], n)
        for f in range(FACTORS):
            v = self.vector[term, f]
            out += 0.5 * (np.bincount(text, v, n) ** 2 - np.bincount(text, v * v, n))
        return out

    def fit(self, rows: list[np.ndarray], label: np.ndarray) -> None:
        """Adaptive gradient descent on the log loss, from the log odds of each term by itself."""
        draw = np.random.default_rng(11)
        places = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        toxic = np.bincount(places, np.repeat(label, [len(r) for r in rows]), len(self.known))
        other = np.bincount(places, minlength=len(self.known)) - toxic
        n = label.sum()
        start = np.log((toxic + 0.5) / (n + 1)) - np.log((other + 0.5) / (len(rows) - n + 1))
        self.weight = start.copy()
        seen_w, seen_v = np.full(len(self.known), 1e-6), np.full(self.vector.shape, 1e-6)
        seen_b = 1e-6
        for _ in range(ROUNDS):
            order = draw.permutation(len(rows))
            for first in range(0, len(rows), BATCH):
                part = order[first : first + BATCH]
                text = np.repeat(np.arange(len(part)), [len(rows[i]) for i in part])
                term = np.concatenate([rows[i] for i in part])
                kept = draw.random(len(term)) < np.where(draw.random(len(part)) < 0.5, KEEP, 1.0)[text]
                text, term = text[kept], term[kept]
                off = (logistic(self.raw(text, term, len(part))) - label[part]) / len(part)
                seen_b += off.sum() ** 2
                self.bias -= RATE * off.sum() / np.sqrt(seen_b)
                if not len(term):
                    continue
                used, place = np.unique(term, return_inverse=True)
                slope = np.bincount(place, off[text]) + DECAY * (self.weight[used] - start[used])
                v = self.vector[term]
                sums = np.stack([np.bincount(text, v[:, f], len(part)) for f in range(FACTORS)], axis=1)
                each = off[text][:, None] * (sums[text] - v)
                tilt = np.stack([np.bincount(place, each[:, f]) for f in range(FACTORS)], axis=1) + DECAY * self.vector[used]
                seen_w[used] += slope**2
                seen_v[used] += tilt**2
                self.weight[used] -= RATE * slope / np.sqrt(seen_w[used])
                self.vector[used] -= RATE * tilt / np.sqrt(seen_v[used])

    def score(self, texts: pa.Array) -> list:
        return [logistic(self.raw(*present(texts, self.known), len(texts)))]


def _clear_terms(rows: DataFrame, n: dict[int, int], most: int) -> np.ndarray:
    """The terms whose shares among toxic and other documents differ most clearly, sorted."""
    counts = rows.select(F.explode("terms").alias("term"), "label").groupBy("term").agg(
        F.sum("label").alias("a"), F.count(F.lit(1)).alias("both")
    )
    share = F.col("both") / (n[0] + n[1])
    gap = F.col("a") / n[1] - (F.col("both") - F.col("a")) / n[0]
    error = F.sqrt(share * (1 - share) * (1 / n[0] + 1 / n[1]) + 1e-12)
    found = counts.where(F.col("both") >= LEAST_DOCS).select("term", F.abs(gap / error).alias("clear"))
    found = found.where(F.col("clear") >= CLEAR).orderBy(F.desc("clear"), "term").limit(most)
    return np.sort(np.array([r["term"] for r in found.collect()], np.int64))


def fit(docs: DataFrame, labels: DataFrame, train: Column, label: str = "toxic", sample: int = SAMPLE) -> Machine | None:
    """Learn from a sample of the labelled documents for which ``train`` holds.

    At most ``MOST_TERMS`` terms and, per sampled document, those of them that it has reach the driver.
    """
    rows = labelled(docs, labels, label, train, sample)
    field = T.StructType([T.StructField("terms", T.ArrayType(T.LongType()))])

    def judge():
        def rate(texts):
            text, term = present(texts)
            cuts = np.searchsorted(text, np.arange(len(texts) + 1))
            return [pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(term))]

        return rate

    known = with_results(rows, "text", field, judge, "found", given="arrow")
    known = written(known.select("doc_id", F.col("label").cast("int").alias("label"), "found.terms"), "terms")
    n = {0: 0, 1: 0} | {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if not n[0] or not n[1]:
        return None
    terms = _clear_terms(known, n, MOST_TERMS)
    wanted = F.lit(terms.tolist()).cast("array<long>")
    got = known.select("doc_id", "label", F.array_intersect("terms", wanted).alias("terms")).collect()
    got.sort(key=lambda r: (r["doc_id"], len(r["terms"]), r["terms"]))
    machine = Machine(terms, float(np.log(n[1] / n[0])))
    machine.fit(
        [np.searchsorted(terms, np.sort(np.array(r["terms"], np.int64))) for r in got], np.array([r["label"] for r in got], float)
    )
    return machine


def scored(df: DataFrame, machine: Machine | None, text: str = "text", column: str = "toxicity") -> DataFrame:
    """``df`` with a struct whose ``score`` is the probability that a text is toxic."""

    def judge():
        return machine.score if machine is not None else lambda texts: [[0.0] * len(texts)]

    return with_results(df, text, SCORE, judge, column, given="arrow")
