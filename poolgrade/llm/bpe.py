"""Byte-pair encoding as a bounded-lookahead streaming transducer, and decoding as a state machine.

The encoder takes text in pieces of any size and emits token ids as soon as no later text can change
them; it keeps one unfinished piece, bounded by the merge list and not by the text.

*Sufficient lookahead.* Take two byte strings that share a prefix and merge both by rank. A rule
(u, v) can move the end of their common tokens back only if u is the last common token and v follows it
in one of them; then the common part ends |u| bytes earlier, and what follows it begins with u. So
the next rule that moves it back has a higher rank and a right side that begins with u. The heaviest such
chain of rules, by summed |u|, is computed in one pass over the merge list; a token that ends that many
bytes before the end of the known bytes is final, and the bytes after it can be encoded by themselves.

Empty and null texts have no tokens. The end-of-text marker of the vocabulary inside a text becomes
its own id, as the tokenizers library does it.
"""

from __future__ import annotations

import json
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .frames import with_results, without
from .words import binaries, gathered, listed, stretches, unpacked

# The pre-tokenisation pattern of the byte-level vocabularies, and the letters and numbers
# that newer Unicode versions have and the vocabularies' pattern treats as symbols.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?[^\s{L}{N}]+|\s+(?!\S)|\s+"
NEWER = (
    "0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF "
    "10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 "
    "16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 "
    "191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE "
    "1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 "
    "3D000-3FC3F"
)
SPACES = r"\s"

HOLD = 16  # characters kept back: more than a contraction or the end-of-text marker needs
FEED = 1 << 20  # characters of a text handed over at a time
OPEN = 4096  # an unfinished piece of this length is encoded by the transducer
BLOCK = 1024  # bytes the transducer gathers beyond its lookahead
SLICE_BYTES = 1 << 22  # of text whose new words are merged together
LONG = 40  # characters of a word or piece that is remembered
MEMO = 100_000  # remembered words per generation; two generations are kept
NONE = 1 << 62


def _newer() -> str:
    spans = (s.split("-") for s in NEWER.split())
    return "".join("-".join(f"\\U{int(x, 16):08X}" for x in span) for span in spans)


def _pattern(exact: bool) -> regex.Pattern:
    kinds = {k: f"[\\p{{{k}}}--[{_newer()}]]" if exact else f"\\p{{{k}}}" for k in "LN"}
    if not exact:
        return regex.compile(PATTERN.replace("[^\\s{L}{N}]", r"[^\s\p{L}\p{N}]").replace("{L}", kinds["L"]).replace("{N}", kinds["N"]))
    rest = f"[^\\s{kinds['L']}{kinds['N']}]"
    return regex.compile(
        PATTERN.replace("[^\\s{L}{N}]", rest).replace("{L}", kinds["L"]).replace("{N}", kinds["N"]), regex.V1
    )


class Memo(dict):
    """Remembered results; a full generation becomes the old one, and what is asked again comes back."""

    def __init__(self, make, most: int = MEMO):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value

    def recall(self, keys: set) -> set:
        """The keys that neither generation knows; those of the old one come back."""
        missing = keys.difference(self)
        back = missing.intersection(self.old)
        self.add(dict(zip(back, map(self.old.__getitem__, back))))
        return missing - back

    def add(self, more: dict) -> None:
        if len(self) + len(more) > self.most:
            self.old = dict(self)
            self.clear()
        self.update(more)

    def get(self, key):
        value = super().get(key)
        return self.old.get(key) if value is None else value


class Vocabulary:
    """Token bytes, merge rules and special tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        shown = byte_letters()
        back = {c: b for b, c in enumerate(shown)}
        ids = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ()) if t.get("special")}
        self.bytes = [b""] * (max([*ids.values(), *self.special.values()]) + 1)
        for token, i in ids.items():
            self.bytes[i] = token.encode() if token in self.special else bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.single = [ids[c] for c in shown]
        self.rules: dict[int, int] = {}
        self.chain: list[tuple[bytes, bytes]] = []
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.rules[ids[left] << 20 | ids[right]] = rank << 20 | ids[left + right]
            self.chain.append((self.bytes[ids[left]], self.bytes[ids[right]]))
        self.lookahead = sufficient_lookahead(self.chain)
        self.first = np.array(self.single, np.int64)
        self.pairs = np.array(sorted(self.rules), np.int64)
        self.results = np.array([self.rules[p] for p in self.pairs.tolist()], np.int64)

    def merge(self, text: bytes) -> list[int]:
        """Ids of one piece: the rule of the lowest rank first, from left to right."""
        parts = [self.single[b] for b in text]
        rule = self.rules.get
        found = [rule(a << 20 | b, NONE) for a, b in zip(parts, parts[1:])]
        while found and (best := min(found)) != NONE:
            token, at = best & 0xFFFFF, found.index(best)
            while at >= 0:  # each place of the rule, from left to right; only its neighbours change
                parts[at : at + 2] = [token]
                del found[at]
                if at < len(found):
                    found[at] = rule(token << 20 | parts[at + 1], NONE)
                if at:
                    found[at - 1] = rule(parts[at - 1] << 20 | token, NONE)
                try:
                    at = found.index(best, at + 1)
                except ValueError:
                    break
        return parts


    def merge_many(self, texts: list[bytes]) -> list[bytes]:
        """Packed ids of many short pieces at once: each round merges the best pair of every piece in numpy."""
        out: list[bytes] = [b""] * len(texts)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        for size in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == size)
            if size == 0:
                continue
            data = np.frombuffer(b"".join([texts[i] for i in rows.tolist()]), np.uint8).reshape(len(rows), size)
            parts = self.first[data]
            found = np.full((len(rows), size), NONE, np.int64)
            found[:, :-1] = self.ranks(parts[:, :-1], parts[:, 1:])
            for left in range(size, 0, -1):
                at = found.argmin(axis=1)
                line = np.arange(len(rows))
                best = found[line, at]
                done = best == NONE
                if done.any():
                    block = parts[done, :left].astype("<u4").tobytes()
                    for k, row in enumerate(rows[done].tolist()):
                        out[row] = block[4 * left * k : 4 * left * (k + 1)]
                    go = ~done
                    rows, parts, found, at, best = rows[go], parts[go], found[go], at[go], best[go]
                    line = np.arange(len(rows))
                if not len(rows):
                    break
                # close the gap behind the merged pair, then look up its two neighbours
                source = np.arange(left - 1)[None, :]
                source = source + (source > at[:, None])
                token = best & 0xFFFFF
                parts = np.take_along_axis(parts, source, 1)
                parts[line, at] = token
                found = np.take_along_axis(found, source, 1)
                found[line, at] = NONE
                found[:, -1] = NONE
                right = np.flatnonzero(at < left - 2)
                found[right, at[right]] = self.ranks(token[right], parts[right, at[right] + 1])
                right = np.flatnonzero(at > 0)
                found[right, at[right] - 1] = self.ranks(parts[right, at[right] - 1], token[right])
        return out

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left << 20 | right
        at = np.searchsorted(self.pairs, wanted)
        at[at == len(self.pairs)] = 0
        return np.where(self.pairs[at] == wanted, self.results[at], NONE)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + others.index(b)) for b in range(256)]


def sufficient_lookahead(rules: list[tuple[bytes, bytes]]) -> int:
    """Bytes that must be known after the end of a token for it to be final; see the module text."""
    heaviest: dict[bytes, int] = {}
    most = 0
    for left, right in rules:
        before = max(heaviest.get(right[:n], 0) for n in range(1, len(right) + 1))
        weight = before + len(left)
        if weight > heaviest.get(left, 0):
            heaviest[left] = weight
        most = max(most, weight)
    return most


class Piece:
    """The transducer for one piece of any length: feed bytes, get the ids that are final."""

    def __init__(self, vocabulary: Vocabulary):
        self.words, self.known = vocabulary, b""

    def feed(self, more: bytes) -> list[int]:
        self.known += more
        out: list[int] = []
        ahead = self.words.lookahead
        while len(self.known) >= ahead + BLOCK:
            window = self.known[: 2 * (ahead + BLOCK)]
            end, sizes = 0, self.words.bytes
            for token in self.words.merge(window):
                if end + len(sizes[token]) > len(window) - ahead:
                    break
                end += len(sizes[token])
                out.append(token)
            if not end:
                break
            self.known = self.known[end:]
        return out

    def finish(self) -> list[int]:
        out, self.known = self.words.merge(self.known), b""
        return out


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Codes:
    """A vocabulary with its patterns and what it remembers of words; one per Python worker."""

    def __init__(self, path: str):
        self.words = Vocabulary(path)
        self.common, self.exact = _pattern(False), _pattern(True)
        self.newer = regex.compile(f"[{_newer()}]")
        self.first_newer = chr(int(NEWER[:4], 16))
        self.marker = regex.compile("|".join(map(regex.escape, self.words.special)) or r"(?!)")
        self.cut = regex.compile(r"(?<=\S)(?=\s)")
        self.loose = regex.compile(r"\s ")
        self.odd = regex.compile(r"\s | \s")
        self.piece = Memo(lambda p: packed(self.words.merge(p.encode())))
        self.spaced = Memo(lambda word: self.short(" " + word))

    def learn(self, words: list[str]) -> None:
        """Remember these words as they stand after a space; their new pieces are merged together.

        Words with blanks at an end, markers or great length are left to `after_space`.
        """
        missing = [w for w in self.spaced.recall(set(words)) if 0 < len(w) <= LONG]
        line = " " + " ".join(missing)
        if self.odd.search(line) or self.marker.search(line):
            missing = [w for w in missing if not self.odd.search(f" {w} ") and not self.marker.search(w)]
            line = " " + " ".join(missing)
        if not missing:
            return
        # no word has a space inside, so each begins at the next piece that has one
        pieces = self.pattern(line).findall(line)
        different = set(pieces)
        new = list(self.piece.recall(different))
        self.piece.add(dict(zip(new, self.words.merge_many([p.encode() for p in new]))))
        ids = dict(zip(different, map(self.piece.__getitem__, different)))
        starts = [i for i, p in enumerate(pieces) if p[0] == " "]
        packs = list(map(ids.__getitem__, pieces))
        ends = [*starts[1:], len(pieces)]
        self.spaced.add(
            {w: packs[a] if b - a == 1 else b"".join(packs[a:b]) for w, a, b in zip(missing, starts, ends, strict=True)}
        )

    def after_space(self, words: list[str], path: str) -> list[bytes]:
        """Ids of each word after a space."""
        self.learn(words)
        out = [self.spaced.get(w) for w in words]
        return [encode(" " + w, path) if x is None else x for w, x in zip(words, out)]

    def pattern(self, text: str) -> regex.Pattern:
        return self.common if text.isascii() or max(text) < self.first_newer or not self.newer.search(text) else self.exact

    def short(self, text: str) -> bytes:
        """Ids of a text that begins and ends at piece ends and has no marker."""
        pieces = self.pattern(text).findall(text)
        if len(pieces) == 1 and len(text) <= LONG:
            return self.piece[text]
        out = []
        for piece in pieces:
            if len(piece) <= LONG:
                out.append(self.piece[piece])
                continue
            run = Piece(self.words)
            for at in range(0, len(piece), OPEN):
                out.append(packed(run.feed(piece[at : at + OPEN].encode())))
            out.append(packed(run.finish()))
        return b"".join(out)

    def plain(self, text: str) -> bytes:
        """`short`, through the remembered words: the pattern always cuts where a space follows a non-space."""
        if not text:
            return b""
        if self.loose.search(text):
            return b"".join(
                self.spaced[p[1:]] if p[0] == " " and len(p) <= LONG else self.short(p) for p in self.cut.split(text) if p
            )
        first, *rest = text.split(" ")
        if max(map(len, rest), default=0) > 2000:
            return self.short(first) + b"".join(self.spaced[w] if len(w) <= LONG else self.short(" " + w) for w in rest)
        return self.short(first) + b"".join(map(self.spaced.__getitem__, rest))


class Encoder:
    """``feed`` text in any pieces, ``finish`` at its end; both give little-endian 32-bit ids."""

    def __init__(self, codes: Codes):
        self.codes, self.tail = codes, ""
        self.run: Piece | None = None
        self.more: regex.Pattern | None = None

    def feed(self, text: str) -> bytes:
        known, self.tail = self.tail + text, ""
        out = []
        if self.run is None:
            cut = self._cut(known)
            if cut:
                out.append(self._marked(known[:cut]))
                known = known[cut:]
        if self.run is None and len(known) <= OPEN:
            self.tail = known
        else:
            out.append(self._open(known, False))
        return b"".join(out)

    def finish(self) -> bytes:
        known, self.tail = self.tail, ""
        return self._open(known, True) if self.run is not None else self._marked(known)

    def _cut(self, known: str) -> int:
        """The last place with a non-space before and a space after it; both sides encode by themselves."""
        at = len(known)
        while (at := known.rfind(" ", 1, at)) > 0:
            if not known[at - 1].isspace():
                return at
        return 0

    def _marked(self, text: str) -> bytes:
        """A text that ends here, cut at markers."""
        marker = self.codes.marker.search(text)
        if marker is None:
            return self.codes.plain(text)
        special = packed([self.codes.words.special[marker[0]]])
        return self.codes.plain(text[: marker.start()]) + special + self._marked_rest(text[marker.end() :])

    def _marked_rest(self, text: str) -> bytes:
        out = []
        while (marker := self.codes.marker.search(text)) is not None:
            out += [self.codes.plain(text[: marker.start()]), packed([self.codes.words.special[marker[0]]])]
            text = text[marker.end() :]
        return b"".join([*out, self.codes.plain(text)])

    def _open(self, known: str, last: bool) -> bytes:
        """Text without a cut for long: whole pieces go out, a long unfinished one through the transducer."""
        out = []
        while (marker := self.codes.marker.search(known)) is not None:
            out += [self._ended(known[: marker.start()]), packed([self.codes.words.special[marker[0]]])]
            known = known[marker.end() :]
        if last:
            return b"".join([*out, self._ended(known)])
        sure = len(known) - HOLD
        at = 0
        while at < sure:
            if self.run is not None:
                end = self.more.match(known, at).end()
                whole = end <= sure
                end = end - (self.more.pattern == SPACES + "*") if whole else sure  # the last space goes with what follows
                out.append(packed(self.run.feed(known[at:end].encode())))
                at = end
                if whole:
                    out.append(packed(self.run.finish()))
                    self.run = None
                continue
            match = self.codes.exact.match(known, at)
            if match.end() <= sure:
                out.append(self.codes.short(match[0]))
                at = match.end()
            elif sure - at < OPEN:
                break
            else:
                self.run, self.more = Piece(self.codes.words), self._kind(match[0])
                out.append(packed(self.run.feed(known[at:sure].encode())))
                at = sure
        self.tail = known[at:]
        return b"".join(out)

    def _kind(self, piece: str) -> regex.Pattern:
        """The pattern of what may follow inside a piece: letters, numbers, spaces or other symbols."""
        letters, numbers = (f"[\\p{{{k}}}--[{_newer()}]]" for k in "LN")
        last = piece[-1]
        for kind in (SPACES, letters, numbers):
            if regex.match(kind, last, regex.V1):
                break
        else:
            kind = f"[^\\s{letters}{numbers}]"
        return regex.compile(f"{kind}*", regex.V1)

    def _ended(self, text: str) -> bytes:
        """The text up to a marker or the end, with the open piece closed first."""
        out = []
        if self.run is not None:
            end = self.more.match(text).end()
            if self.more.pattern == SPACES + "*" and end < len(text):
                end -= 1
            out = [packed(self.run.feed(text[:end].encode())), packed(self.run.finish())]
            self.run, text = None, text[end:]
        return b"".join([*out, self.codes.plain(text)])


class Decoder:
    """Bytes of tokens in, text out; an unfinished character waits, a broken one becomes U+FFFD."""

    # bytes that a character has, by its first byte's upper five bits; 0: not a first byte
    SIZES = [1] * 16 + [0] * 8 + [2] * 4 + [3] * 2 + [4] + [0]

    def __init__(self, vocabulary: Vocabulary):
        self.token, self.wait = vocabulary.bytes.__getitem__, b""

    def feed(self, ids) -> str:
        data = self.wait + b"".join(map(self.token, ids))
        keep = 0
        for back in range(1, min(3, len(data)) + 1):
            size = self.SIZES[data[-back] >> 3]
            if size:
                if size > back and self._may_go_on(data[-back:]):
                    keep = back
                break
        self.wait = data[len(data) - keep :]
        return data[: len(data) - keep].decode("utf-8", "replace")

    @staticmethod
    def _may_go_on(start: bytes) -> bool:
        """True if some bytes make ``start`` a whole character; else it is broken already."""
        low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(
            start[0], (0x80, 0xBF)
        )
        if start[0] in (0xC0, 0xC1) or start[0] > 0xF4:
            return False
        return len(start) < 2 or low <= start[1] <= high and all(0x80 <= b <= 0xBF for b in start[2:])

    def finish(self) -> str:
        out, self.wait = self.wait.decode("utf-8", "replace"), b""
        return out


@lru_cache(maxsize=2)
def codes(path: str) -> Codes:
    return Codes(path)


def encode(text: str | None, path: str) -> bytes:
    """Little-endian 32-bit ids of a whole text."""
    encoder = Encoder(codes(path))
    text = text or ""
    out = [encoder.feed(text[at : at + FEED]) for at in range(0, len(text), FEED)]
    return b"".join([*out, encoder.finish()])


def decode(ids: bytes, path: str) -> str:
    decoder = Decoder(codes(path).words)
    numbers = np.frombuffer(ids, dtype="<u4")
    out = [decoder.feed(numbers[at : at + FEED].tolist()) for at in range(0, len(numbers), FEED)]
    return "".join([*out, decoder.finish()])


IDS = T.StructType([T.StructField("ids", T.BinaryType())])
CODED = T.StructType([*IDS.fields, T.StructField("decoded", T.StringType())])


def encoded(df: DataFrame, path: str, text: str = "text", column: str = "bpe", back: bool = False) -> DataFrame:
    """``df`` with a struct: ``ids`` (little-endian 32-bit numbers) and, if ``back``, ``decoded`` from them.

    ``path`` is a byte-level vocabulary file that every executor has. Null texts count as empty.
    """

    def judge():
        words = codes(path)

        def rate(texts):
            cut = stretches(texts)
            ids = words.after_space(listed(cut.after), path) + [encode(w, path) for w in cut.others]
            column = binaries(*gathered(cut, *unpacked(ids)))
            return [column, [decode(i, path) for i in column.to_pylist()]] if back else [column]

        return rate

    return with_results(df, text, CODED if back else IDS, judge, column, given="arrow", most=SLICE_BYTES)


def decoded(df: DataFrame, path: str, ids: str = "ids", column: str = "text") -> DataFrame:
    """``df`` with the text of a column of little-endian 32-bit ids (null: null)."""
    df = without(df, column)
    names, at = df.columns, df.columns.index(ids)

    def run(batches):
        for batch in batches:
            texts = [None if x is None else decode(x, path) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, column])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(column, T.StringType())]))
