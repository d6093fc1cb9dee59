"""Language identification in two steps: the family first, then the language within it.

A text is the square roots of its hashed letter trigram shares, a vector of length one. Families are told apart by
one-versus-one linear support vector machines, and so are the languages of the family that wins. A duel's margin
goes through a logistic curve; the score is the least sure duel that the answer won, between 0 and 1.

Null texts and texts without a letter are ``und`` with score 0. Without training rows all texts are ``und``.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import with_results
from .samples import logistic, sampled
from .words import byte_table, flat_bytes

UNKNOWN = "und"
BITS = 11
SAMPLE_PER_LANGUAGE = 500
ROUNDS = 200
PENALTY = 1e-4
STEEPNESS = 4.0

# Families of the commonest written languages; a code that is not here is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "turkic": "tr az kk uz ky tk",
    "uralic": "fi et hu",
    "indic": "hi bn ur mr ne pa gu",
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

LETTERS = byte_table("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", True)
GUESS = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def trigrams(texts: pa.Array) -> np.ndarray:
    """One row per text: roots of the shares of its hashed trigrams, after mapping non-letters to blanks."""
    flat, edges = flat_bytes(texts)
    n, size = len(texts), 1 << BITS
    data = LETTERS[flat].astype(np.uint32)
    if len(data) < 3:
        return np.zeros((n, size), np.float32)
    code = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
    code = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    owner = np.repeat(np.arange(n, dtype=np.int64) << BITS, np.diff(edges))
    whole = np.ones(len(data), bool)
    for back in (1, 2):
        at = edges[1:] - back
        whole[at[at >= 0]] = False
    whole = whole[:-2]
    counts = np.bincount((owner[:-2] + code)[whole], minlength=n * size).reshape(n, size)
    total = np.maximum(counts.sum(axis=1, keepdims=True), 1)
    return np.sqrt(counts / total).astype(np.float32)


def support_vector(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and bias of a linear SVM with squared hinge loss, classes weighted alike, by accelerated descent."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = ahead = np.zeros(x.shape[1], np.float32)
    step = 1.0 / (2 * 2 + PENALTY)  # rows have length sqrt 2 with the bias, weights sum to one
    for k in range(ROUNDS):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        after = ahead - step * (PENALTY * ahead - 2 * x.T @ (weight * slack * y))
        ahead = after + k / (k + 3) * (after - w)
        w = after
    return w


class Duels:
    """One-versus-one machines of some classes."""

    def __init__(self, x: np.ndarray, names: np.ndarray):
        self.classes = sorted(set(names.tolist()))
        self.machines = {}
        for a, b in combinations(range(len(self.classes)), 2):
            rows = (names == self.classes[a]) | (names == self.classes[b])
            self.machines[a, b] = support_vector(x[rows], np.where(names[rows] == self.classes[a], 1.0, -1.0).astype(np.float32))

    def decide(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class number and the least margin that it won its duels with; ties go to the larger sum of margins."""
        n = len(self.classes)
        margins = np.zeros((len(x), n, n), np.float32)
        for (a, b), w in self.machines.items():
            margins[:, a, b] = x @ w[:-1] + w[-1]
            margins[:, b, a] = -margins[:, a, b]
        best = ((margins > 0).sum(axis=2) + 1e-3 * np.tanh(margins.sum(axis=2))).argmax(axis=1)
        own = margins[np.arange(len(x)), best]
        own[np.arange(len(x)), best] = np.inf
        return best, own.min(axis=1) if n > 1 else np.full(len(x), np.inf)


class Model:
    def __init__(self, x: np.ndarray, languages: np.ndarray):
        family = np.array([FAMILY.get(code, code) for code in languages.tolist()])
        self.families = Duels(x, family)
        self.within = {f: Duels(x[family == f], languages[family == f]) for f in self.families.classes}

    def guess(self, texts: pa.Array) -> list:
        x = trigrams(texts)
        lettered = pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False).to_numpy(zero_copy_only=False)
        family, sure = self.families.decide(x)
        names = np.full(len(x), UNKNOWN, object)
        for k, name in enumerate(self.families.classes):
            rows = np.flatnonzero(family == k)
            if len(rows):
                duel = self.within[name]
                best, own = duel.decide(x[rows])
                names[rows] = np.array(duel.classes, object)[best]
                sure[rows] = np.minimum(sure[rows], own)
        names[~lettered] = UNKNOWN
        score = np.where(lettered, logistic(STEEPNESS * sure.astype(np.float64)), 0.0)
        return [names.tolist(), score]


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE_PER_LANGUAGE) -> Model | None:
    """Learn from about ``sample`` rows of each language; only their trigram vectors reach the driver."""
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.where("text IS NOT NULL AND lang IS NOT NULL")
    chosen = sampled(rows, F.col("text"), sample, by="lang")
    field = T.StructType([T.StructField("x", T.BinaryType())])
    judge = lambda: lambda texts: [[r.tobytes() for r in trigrams(texts).astype("<f4")]]
    got = with_results(chosen, "text", field, judge, "vector", given="arrow").select("lang", "vector.x").collect()
    if not got:
        return None
    got.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    x = np.stack([np.frombuffer(r["x"], "<f4") for r in got])
    return Model(x, np.array([r["lang"] for r in got]))


def identified(df: DataFrame, model: Model | None, text: str = "text", column: str = "language") -> DataFrame:
    """``df`` with a struct: lang_pred, score."""

    def judge():
        if model is None:
            return lambda texts: [[UNKNOWN] * len(texts), [0.0] * len(texts)]
        return model.guess

    return with_results(df, text, GUESS, judge, column, given="arrow")
