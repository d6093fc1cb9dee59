"""SentencePiece encoding by a merge-type prefix table, and decoding.

A piece model of the merge type joins the neighbours whose joint piece has the best score, leftmost first,
until nothing joins. Two facts make a table of prefixes enough: every prefix of a text has one last token,
and a row of tokens is the encoding exactly if each neighbouring pair is (the pair's own text encodes to it).
So one pass of an automaton over the text gives the tokens that end at each place; of these the one that
goes with the last token of the prefix before it is stored, and the ids are read off backwards from the
text's end. Pair tests are made by merging the two tokens' text and are remembered.

Where two characters stand together in no piece, a text may be cut. Texts are cut before each run of blanks, at
line ends and between a letter and a mark, and equal stretches of up to ``LONG`` characters are looked up in a
memory of bounded size. A longer stretch costs four bytes a character. Characters without a piece become byte
tokens. Null texts count as empty.

Decoding joins the tokens' bytes, drops the blank that encoding puts in front, and turns broken bytes into
U+FFFD one by one; control tokens give nothing.
"""

from __future__ import annotations

import codecs
import re
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import Memo
from .frames import bounded_batches, give_back, with_results, without
from .words import listed

BLANK = "▁"  # fixed value: stands for a blank in pieces
LETTERS, MARKS, ENDS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff", ".,;:!?)\"", "\n\t"
LONG = 40  # characters of a stretch that is remembered
PAIRS = 1 << 19  # pair tests remembered
STRETCHES = 1 << 19  # stretches remembered per generation; two generations are kept, at most 250 MB a worker
NOTHING, START = -(1 << 30), -(1 << 29)  # place without a token yet; before the first token

# Fixed values of the model format.
MERGE_MODEL = 2
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


def _one_by_one(error):
    return "�" * (error.end - error.start), error.end


codecs.register_error("one by one", _one_by_one)


class Pieces:
    """A model file's pieces with the automaton over them, and what is remembered; one per Python worker."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        rules, training = model.normalizer_spec, model.trainer_spec
        kinds = {p.type for p in model.pieces}
        plain = not rules.precompiled_charsmap and not rules.remove_extra_whitespaces and rules.escape_whitespaces
        if training.model_type != MERGE_MODEL or not plain or not kinds <= {NORMAL, UNKNOWN, CONTROL, BYTE} or BYTE not in kinds:
            raise ValueError("only merge models with byte tokens, plain pieces and texts left as they are")
        self.score = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.id = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.chars = {c for piece in self.score for c in piece}
        if not self.chars <= self.score.keys() or any(BLANK in piece.lstrip(BLANK) for piece in self.score):
            raise ValueError("a piece has a character that is no piece, or a blank after another character")
        byte = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.byte = [byte[b] for b in range(256)]
        self.end = next(i for i, p in enumerate(model.pieces) if p.piece == training.eos_piece)
        self.stretch = self._cuts()
        self.blank_first = rules.add_dummy_prefix
        self.text = [p.piece for p in model.pieces]
        self.size = [len(p.piece) for p in model.pieces]
        self.control = {i for i, p in enumerate(model.pieces) if p.type == CONTROL}
        self.bytes = [self._bytes(p, training.unk_surface) for p in model.pieces]
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.id.items():
            if self.merge(piece) == [piece]:  # others never stand in an encoding
                self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.known = Memo(self.packed, STRETCHES)

    def _cuts(self) -> re.Pattern:
        """What a text is cut into: never inside a place that a piece covers."""
        letter = re.compile(f"[{LETTERS}]")
        joined = {b for piece in self.score for a, b in zip(piece, piece[1:]) if letter.match(a)}
        ends = re.escape("".join(c for c in ENDS if c not in self.chars))
        marks = re.escape("".join(c for c in MARKS if c not in joined))
        ways = [f" *+[{LETTERS}]++(?=[{marks}])"] * bool(marks) + [f"[{ends}]+"] * bool(ends)
        return re.compile("|".join([*ways, f" +[^ {ends}]*", f"[^ {ends}]+"]))

    def _bytes(self, piece, unknown: str) -> bytes:
        if piece.type == BYTE:
            return bytes([int(piece.piece[1:-1], 16)])
        shown = {CONTROL: "", UNKNOWN: unknown}.get(piece.type, piece.piece.replace(BLANK, " "))
        return shown.encode()

    def merge(self, text: str) -> list[str]:
        """The pieces of a short text by merging, the best score first, of equal ones the leftmost."""
        parts = list(text)
        while True:
            joint = [self.score.get(a + b) for a, b in zip(parts, parts[1:])]
            ways = [s for s in joint if s is not None]
            if not ways:
                return parts
            at = joint.index(max(ways))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def goes_with(self, left: int, right: int) -> bool:
        """True if the two tokens' joint text encodes to just these two; the answer is remembered."""
        a, b = self.text[left], self.text[right]
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        fits = self.pairs[left * len(self.text) + right] = self.merge(a + b) == [a, b]
        return fits

    def prefix_table(self, text: str) -> array:
        """The last token of each prefix, by its length; a character without a piece is the negative of its code."""
        last = array("i", [NOTHING]) * (len(text) + 1)
        last[0] = START
        strange = set(text) - self.chars
        if strange:
            for at in [at for at, c in enumerate(text) if c in strange]:
                last[at + 1] = -ord(text[at]) - 1
        known, width, goes_with = self.pairs.get, len(self.text), self.goes_with
        for end, (token, size) in self.automaton.iter(text):
            end += 1
            if last[end] == NOTHING:
                before = last[end - size]
                # no piece reaches over the start or a character without a piece
                if before >= 0:
                    fits = known(before * width + token)
                    if fits is None:
                        fits = goes_with(before, token)
                    if not fits:
                        continue
                last[end] = token
        return last

    def ids(self, stretch: str) -> list[int]:
        text = stretch.replace(" ", BLANK)
        last, at, out = self.prefix_table(text), len(text), []
        while at:
            token = last[at]
            if token >= 0:
                out.append(token)
                at -= self.size[token]
            else:
                out += [self.byte[b] for b in reversed(text[at - 1].encode())]
                at -= 1
        out.reverse()
        return out

    def packed(self, stretch: str) -> bytes:
        return array("i", self.ids(stretch)).tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a whole text, without an end id."""
        if not text:
            return b""
        text = text.replace(BLANK, " ")
        known, make = self.known, self.packed
        stretches = self.stretch.findall(" " + text if self.blank_first else text)
        return b"".join([known[s] if len(s) <= LONG else make(s) for s in stretches])

    def decode(self, ids: list[int]) -> str:
        out, first = [], self.blank_first
        at = 0
        for stop in [k for k, i in enumerate(ids) if i in self.control] + [len(ids)]:
            run = ids[at:stop]
            if run:
                data = b"".join(map(self.bytes.__getitem__, run)).decode("utf-8", "one by one")
                if first and self.text[run[0]].startswith(BLANK):
                    data = data[1:]
                out.append(data)
                first = False
            at = stop + 1
        return "".join(out)


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode(text: str | None, path: str, end: bool = True) -> list[int]:
    model = pieces(path)
    ids = np.frombuffer(model.encode(text or ""), "<i4").tolist()
    return [*ids, model.end] if end else ids


def decode(ids: list[int], path: str) -> str:
    return pieces(path).decode(ids)


IDS = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType()))])
CODED = T.StructType([*IDS.fields, T.StructField("decoded", T.StringType())])


def encoded(df: DataFrame, path: str, text: str = "text", column: str = "pieces", end: bool = True, back: bool = False) -> DataFrame:
    """``df`` with a struct: ``ids``, closed by the end id if ``end``, and, if ``back``, ``decoded`` from them.

    ``path`` is a model file that every executor has. Rows pass one by one: repeated rows, ties and null ids
    change nothing, and other columns stay (one called ``column`` gives way).
    """

    def judge():
        model = pieces(path)
        close = np.array([model.end] if end else [], "<i4").tobytes()

        def rate(texts):
            packs = [model.encode(t or "") + close for t in listed(texts)]
            edges = np.cumsum([0, *map(len, packs)]) >> 2
            flat = np.frombuffer(b"".join(packs), "<i4")
            ids = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(flat, pa.int32()))
            return [ids, [model.decode(np.frombuffer(p, "<i4").tolist()) for p in packs]] if back else [ids]

        return rate

    return with_results(df, text, CODED if back else IDS, judge, column, given="arrow")


def decoded(df: DataFrame, path: str, ids: str = "ids", column: str = "text") -> DataFrame:
    """``df`` with the text of a column of id arrays (null: null)."""
    bounded_batches(df.sparkSession)
    df = without(df, column)
    names, at = df.columns, df.columns.index(ids)

    def run(batches):
        for batch in batches:
            texts = [None if x is None else decode(x, path) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, column])
        give_back()

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(column, T.StringType())]))
