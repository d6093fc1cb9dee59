"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Words are runs of letters, digits and all non-ASCII characters, A-Z lower-cased. A window is ``width``
consecutive words of an item, or a whole shorter item. The automaton reads a document's words and knows,
at each word, the longest stretch ending there that occurs in some item; stretches that hold a window
are hit. Only runs of word pairs that items have as well are read by it, all other words reset it.

Null and empty texts have no words, no hits and are clean; items without words match nothing; repeated
items count once per id, and an item whose id is null hits words without being counted.
"""

from __future__ import annotations

from itertools import chain, repeat

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import fresh, with_results, without, written

WIDTH = 13
COVERAGE = 20  # contaminated: 1 word in so many, or more, is hit
BLOCK_CHARS = 4_000_000  # item characters of one automaton; more items make more automata
SIDE_BY_SIDE = 4  # automata that run in one stage
PAIR_BITS = 20

_KEPT = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
NORMAL = bytes(b if b in _KEPT else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))

SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
HITS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(SPAN)),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def words(text: bytes | None) -> list[bytes]:
    return text.translate(NORMAL).split() if text else []


class Automaton:
    """Suffix automaton of word sequences, with the items that each window belongs to."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], width: int = WIDTH):
        self.width = width
        self.ids: dict[bytes, int] = {}
        texts = [(name, [self.ids.setdefault(w, len(self.ids)) for w in ws]) for name, ws in items if ws]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        pairs = set()
        for _, text in texts:
            last = 0
            for word in text:
                last = self._extend(last, word)
            pairs.update(zip(text, text[1:]))
        self.names = [name for name, _ in texts]
        # items of each window, at the state that stands for it
        self.windows: dict[int, set[int]] = {}
        self.whole: dict[int, list[tuple[int, int]]] = {}  # state: (length, item) of the shorter items
        for i, (_, text) in enumerate(texts):
            state = size = 0
            for word in text:
                state, size = self.step(state, size, word)
                if size >= width:
                    self.windows.setdefault(self.up(state, width), set()).add(i)
            if len(text) < width:
                self.whole.setdefault(self.up(state, len(text)), []).append((len(text), i))
        self.least = min([width, *(len(text) for _, text in texts)])
        self.pairs = np.zeros(1 << PAIR_BITS, bool)
        if pairs:
            left, right = np.array(sorted(pairs), np.int64).T
            self.pairs[pair_code(left, right)] = True

    def _extend(self, last: int, word: int) -> int:
        """The state of the text so far plus ``word``; states of earlier items are shared."""
        nexts, link, size = self.next, self.link, self.size
        if word in nexts[last]:
            known = nexts[last][word]
            return known if size[known] == size[last] + 1 else self._split(last, word, known)
        new = len(nexts)
        nexts.append({})
        size.append(size[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and word not in nexts[at]:
            nexts[at][word] = new
            at = link[at]
        if at >= 0:
            known = nexts[at][word]
            link[new] = known if size[known] == size[at] + 1 else self._split(at, word, known)
        return new

    def _split(self, at: int, word: int, known: int) -> int:
        """Give the stretches of ``known`` up to one word more than ``at`` a state of their own."""
        part = len(self.next)
        self.next.append(dict(self.next[known]))
        self.size.append(self.size[at] + 1)
        self.link.append(self.link[known])
        self.link[known] = part
        while at >= 0 and self.next[at].get(word) == known:
            self.next[at][word] = part
            at = self.link[at]
        return part

    def step(self, state: int, size: int, word: int) -> tuple[int, int]:
        """State and length of the longest known stretch that ends with ``word``."""
        while word not in self.next[state]:
            state = self.link[state]
            if state < 0:
                return 0, 0
            size = self.size[state]
        return self.next[state][word], size + 1

    def up(self, state: int, size: int) -> int:
        """The state of the last ``size`` words of a state's stretch."""
        while self.size[self.link[state]] >= size:
            state = self.link[state]
        return state

    def read(self, run: list[int], base: int, spans: list, found: set) -> None:
        """Add the hit spans (word positions from ``base``) and items of a run of known words."""
        state = size = 0
        for at, word in enumerate(run, base + 1):
            state, size = self.step(state, size, word)
            if size >= self.width:
                self._cover(spans, at - size, at)
                found |= self.windows[self.up(state, self.width)]
            if self.whole and size >= self.least:
                above, reach = state, size
                while above > 0:
                    for length, item in self.whole.get(above, ()):
                        if length <= reach:
                            self._cover(spans, at - length, at)
                            found.add(item)
                    above = self.link[above]
                    reach = self.size[above]

    @staticmethod
    def _cover(spans: list, start: int, end: int) -> None:
        while spans and spans[-1][1] >= start:
            start = min(start, spans.pop()[0])
        spans.append((start, end))

    def scan(self, texts: list[bytes | None]) -> tuple[list, list, list]:
        """Word counts, hit spans and items of each text."""
        split = [words(t) for t in texts]
        counts = [len(w) for w in split]
        total = sum(counts) + len(counts)
        # a stranger after each text keeps runs inside it
        known = np.fromiter(
            chain.from_iterable(chain(map(self.ids.get, w, repeat(-1)), (-1,)) for w in split), np.int64, total
        )
        starts = np.cumsum([0, *(c + 1 for c in counts)])
        spans: list[list] = [[] for _ in texts]
        found: list[set] = [set() for _ in texts]
        inside = known >= 0
        joined = np.zeros(total + 1, bool)  # the word goes on the run of the one before it
        both = np.flatnonzero(inside[1:] & inside[:-1]) + 1
        joined[both] = self.pairs[pair_code(known[both - 1], known[both])]
        firsts = np.flatnonzero(inside & ~joined[:-1])
        breaks = np.flatnonzero(~joined)
        ends = breaks[np.searchsorted(breaks, firsts, side="right")]
        long = ends - firsts >= self.least
        owners = np.searchsorted(starts, firsts[long], side="right") - 1
        for first, end, doc in zip(firsts[long].tolist(), ends[long].tolist(), owners.tolist()):
            self.read(known[first:end].tolist(), first - int(starts[doc]), spans[doc], found[doc])
        items = [sorted({self.names[i] for i in f if self.names[i] is not None}) for f in found]
        return counts, spans, items


def pair_code(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A bucket for a word pair; pairs that share one are told apart by the automaton."""
    return (left * 0x9E3779B1 + right * 0x85EBCA6B >> 7) & ((1 << PAIR_BITS) - 1)


def blocks(items: DataFrame, item_id: str, text: str, most: int) -> list[list[tuple[str | None, list[bytes]]]]:
    """The items' words in parts of about ``most`` characters, dealt by a hash of the id."""
    rows = items.select(F.col(item_id).cast("string").alias("name"), F.col(text).alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = -(-chars // most) or 1
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("name", "text"), F.lit(parts)))
    return [
        [(r["name"], words((r["text"] or "").encode())) for r in dealt.where(F.col("part") == part).collect()]
        for part in range(parts)
    ]


def scanned(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    column: str = "hits",
    width: int = WIDTH,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``docs`` with a struct ``column``: n_words, hit word spans, item ids, n_hit.

    The items are a stated test set. Each automaton holds at most about ``block_chars`` of them and is
    broadcast; further items make further passes, every fourth of which is written out.
    """
    spark = docs.sparkSession
    docs = without(docs, column)
    names = docs.columns
    out, parts = docs, []
    for n, block in enumerate(blocks(items, item_id, item_text, block_chars)):
        if n and n % SIDE_BY_SIDE == 0:
            out = written(out, "decontam")
        shared = spark.sparkContext.broadcast(block)
        parts.append(fresh(out, f"_{column}{n}"))
        out = with_results(out, text, HITS, _scanner(shared, width), parts[-1], given="bytes")
    spans = F.flatten(F.array(*[F.col(p)["spans"] for p in parts]))
    found = F.flatten(F.array(*[F.col(p)["items"] for p in parts]))
    hits = F.struct(
        F.col(parts[0])["n_words"].alias("n_words"),
        F.array_sort(spans).alias("spans"),
        F.array_sort(F.array_distinct(found)).alias("items"),
        covered(F.array_sort(spans)).alias("n_hit"),
    )
    return out.select(*[F.col(f"`{c}`") for c in names], hits.alias(column))


def _scanner(shared, width: int):
    def judge():
        return Automaton(shared.value, width).scan

    return judge


def covered(spans: Column) -> Column:
    """Positions inside at least one of the spans, which are sorted by start."""
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        spans,
        start,
        lambda a, s: F.struct(
            F.greatest(a["end"], s["end"]).alias("end"),
            (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["end"], s["start"]))).alias("n"),
        ),
        lambda a: a["n"],
    )


def contaminated(hits: Column | str, coverage: int = COVERAGE) -> Column:
    hits = F.col(hits) if isinstance(hits, str) else hits
    return (hits["n_hit"] > 0) & (hits["n_hit"] * coverage >= hits["n_words"])


_WORD = regex.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def without_spans(df: DataFrame, text: str = "text", column: str = "hits") -> DataFrame:
    """``df`` with the hit spans cut out of its texts; texts without hits skip Python (null: null)."""
    cut = F.udf(_cut, T.StringType())
    hit = F.coalesce(F.size(F.col(column)["spans"]) > 0, F.lit(False))
    return df.where(hit).withColumn(text, cut(text, F.col(column)["spans"])).unionByName(df.where(~hit))


def _cut(text, spans):
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for start, end in spans:
        out.append(text[at : max(at, places[start][0])])
        at = max(at, places[end - 1][1])
    return "".join([*out, text[at:]])
