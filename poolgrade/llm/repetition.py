"""Quality rules on repetition: characters inside repeated n-grams and repeated lines of a text.

Words are runs of characters other than blanks. For each n-gram length a rolling hash gives every window
of a text a number; windows whose number occurs again are compared word by word, so a hash collision
changes nothing. A longer window can only repeat where a shorter one does, so each length looks at what
the length before it left.

Null texts and texts without words have all counts zero and fail the base rules (fewer than ten words).
"""

from __future__ import annotations

from collections import defaultdict
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .frames import with_results

# Symbols that the base rules count.
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS = 10
BASE = 5  # window of the base rule, in words
BASE_PERCENT = 20
# largest share of a text's word characters inside repeated n-grams, by n, and inside repeated lines
LIMITS = {5: 0.20, 7: 0.18, 10: 0.15}
LINE_LIMIT = 0.30

_MORE = bytes(range(0x80, 0xC0))  # the further bytes of a character
_BLANK = b" \t\n\v\f\r"

RULES = T.StructType(
    [T.StructField(n, T.LongType()) for n in "n_words word_chars n_symbols n_dup_lines n_repeat_words".split()]
    + [T.StructField(f"repeat_share_{n}", T.DoubleType()) for n in LIMITS]
    + [
        T.StructField("line_share", T.DoubleType()),
        T.StructField("base_failed", T.BooleanType()),
        T.StructField("kept", T.BooleanType()),
    ]
)


def repeated(ids: np.ndarray, owner: np.ndarray, length: int, starts: np.ndarray) -> np.ndarray:
    """Those of ``starts`` whose window of ``length`` ids occurs more than once in the same text."""
    starts = starts[starts + length <= len(ids)]
    starts = starts[owner[starts] == owner[np.minimum(starts + length - 1, len(ids) - 1)]]
    if len(starts) < 2:
        return starts[:0]
    code = owner[starts].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(length):
        code = code * np.uint64(0x100000001B3) + ids[starts + k].astype(np.uint64)
        code ^= code >> np.uint64(29)
    order = np.sort(code)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return starts[:0]
    at = np.minimum(np.searchsorted(twice, code), len(twice) - 1)
    starts = starts[twice[at] == code]
    windows = np.stack([owner[starts], *(ids[starts + k] for k in range(length))], axis=1)
    _, back, times = np.unique(windows, axis=0, return_inverse=True, return_counts=True)
    return starts[times[back.ravel()] > 1]


def inside(starts: np.ndarray, length: int, total: int) -> np.ndarray:
    """Marks of the words that a window from one of ``starts`` covers."""
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + length, -1)
    return np.cumsum(edge[:-1]) > 0


def by_text(marks: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(marks)])[edges])


def lines(text: bytes) -> tuple[int, int]:
    """Lines with a word that equal an earlier line, and the word characters in them."""
    seen, count, chars = set(), 0, 0
    parts = text.split(b"\n")
    if len(parts) == len(set(parts)):
        return 0, 0
    for line in parts:
        if line not in seen:
            seen.add(line)
            continue
        word = line.translate(None, _MORE + _BLANK)
        if word:
            count += 1
            chars += len(word)
    return count, chars


def rules(texts: list[bytes | None]) -> list:
    """One column per field of ``RULES``."""
    split = [t.split() if t else [] for t in texts]
    n_words = np.array([len(s) for s in split], np.int64)
    edges = np.concatenate([[0], np.cumsum(n_words)])
    total = int(edges[-1])
    number: defaultdict = defaultdict()
    number.default_factory = number.__len__
    ids = np.fromiter(map(number.__getitem__, chain.from_iterable(split)), np.int64, total)
    owner = np.repeat(np.arange(len(texts)), n_words)
    word_chars = np.array([len(t.translate(None, _MORE + _BLANK)) if t else 0 for t in texts], np.int64)
    n_symbols = np.array([len(t) - len(t.translate(None, SYMBOLS)) if t else 0 for t in texts], np.int64)
    dup = [lines(t) if t else (0, 0) for t in texts]
    whole = np.maximum(word_chars, 1)
    shares, starts, lengths = {}, np.arange(total), None
    n_repeat = np.zeros(len(texts), np.int64)
    for length in sorted(LIMITS):
        starts = repeated(ids, owner, length, starts)
        marks = inside(starts, length, total)
        if length == BASE:
            n_repeat = by_text(marks, edges)
            places = np.flatnonzero(marks)
            words = list(chain.from_iterable(split)) if len(places) else []
            lengths = np.zeros(total, np.int64)
            lengths[places] = [len(words[i].translate(None, _MORE)) for i in places.tolist()]
        shares[length] = by_text(marks * lengths, edges) / whole
    line_share = np.array([c for _, c in dup]) / whole
    failed = (n_words < LEAST_WORDS) | (100 * n_repeat > BASE_PERCENT * n_words)
    kept = ~failed & (line_share <= LINE_LIMIT)
    for length, most in LIMITS.items():
        kept &= shares[length] <= most
    return [
        n_words,
        word_chars,
        n_symbols,
        np.array([c for c, _ in dup], np.int64),
        n_repeat,
        *(shares[n] for n in LIMITS),
        line_share,
        failed,
        kept,
    ]


def judged(df: DataFrame, text: str = "text", column: str = "rules") -> DataFrame:
    """``df`` with a struct of the counts, shares and verdicts of each text."""
    return with_results(df, text, RULES, lambda: rules, column, given="bytes")
