"""Chat formatting by columnar byte assembly.

A turn becomes ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts a bar after a "<" gets a
backslash between them (after the backslashes that are there already), so no control string can stand in
them, and taking one backslash away gives the text back; line ends in roles become ``<|nl|>``.

The bytes of a whole batch are laid out at once: segment lengths give offsets, offsets give scatter
indices, and constant and variable segments are copied into one buffer that becomes the Arrow column.

Turns are ordered by turn, role and text (nulls first). Null roles and texts count as empty; a null
conversation id is a conversation as any other. A conversation may be of any length: it is formatted in
pieces, by several tasks if it is long, and read back as a stream.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import bounded_batches

START, END, LINE = b"<|im_start|>", b"<|im_end|>\n", b"<|nl|>"
LOSS_ROLE = "assistant"

PIECES = "conv_id {kind}, first_turn {turn}, piece long, formatted binary, loss array<struct<start:long,end:long>>"


def escaped(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(pc.fill_null(texts, ""), r"<(\\*)\|", r"<\\\1|")


def unescaped(text: bytes) -> bytes:
    """The text before `escaped`: one backslash less between a "<" and a bar."""
    if b"<\\" not in text:
        return text
    out = []
    for n, part in enumerate(text.split(b"<\\")):
        # a part goes on with backslashes and a bar if the mark before it was made by `escaped`
        made = part.lstrip(b"\\").startswith(b"|")
        out.append(part if n == 0 else (b"<" if made else b"<\\") + part)
    return b"".join(out)


def assembled(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All turns as one byte buffer, the edges of the turns, and where each text begins and ends."""
    roles = pc.replace_substring(escaped(roles), "\n", LINE.decode())
    segments = [START, roles, b"\n", escaped(texts), END]
    n = len(roles)
    sizes = np.empty((n, len(segments)), np.int64)
    for k, s in enumerate(segments):
        sizes[:, k] = len(s) if isinstance(s, bytes) else pc.binary_length(s).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.ravel()).reshape(sizes.shape)
    starts = ends - sizes
    out = np.empty(int(ends[-1, -1]) if n else 0, np.uint8)
    for k, s in enumerate(segments):
        if isinstance(s, bytes):
            out[starts[:, k, None] + np.arange(len(s))] = np.frombuffer(s, np.uint8)
            continue
        offsets = np.frombuffer(s.buffers()[1], np.int32)[s.offset : s.offset + n + 1].astype(np.int64)
        data = np.frombuffer(s.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if s.buffers()[2] else np.zeros(0, np.uint8)
        to = np.repeat(starts[:, k] - (offsets[:-1] - offsets[0]), sizes[:, k]) + np.arange(len(data))
        out[to] = data
    edges = np.concatenate([[0], ends[:, -1]]) if n else np.zeros(1, np.int64)
    return out, edges, np.stack([starts[:, 3], ends[:, 3]], axis=1)


def formatted(
    turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = LOSS_ROLE
) -> DataFrame:
    """Pieces of formatted conversations: conv_id, first_turn, piece, formatted bytes, loss spans in them.

    A conversation's pieces are in order of (first_turn, piece). The rows are dealt by ranges of
    conversation and turn, so a long conversation is formatted by several tasks.
    """
    spark = turns.sparkSession
    bounded_batches(spark)
    rows = turns.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")
    )
    rows = rows.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")
    kinds = dict(rows.dtypes)

    def run(batches):
        piece = 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ids = batch.column("conv_id")
            new = pc.fill_null(pc.not_equal(ids[1:], ids[:-1]), False).to_numpy(zero_copy_only=False)
            null = pc.is_null(ids).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(new | (null[1:] != null[:-1])) + 1).tolist(), n]
            data, edges, spans = assembled(batch.column("role"), batch.column("text"))
            loss = pc.fill_null(pc.equal(batch.column("role"), loss_role), False).to_numpy(zero_copy_only=False)
            first = np.array(cuts[:-1])
            base = np.repeat(edges[first], np.diff(cuts))
            at = np.flatnonzero(loss)
            struct = pa.StructArray.from_arrays(
                [pa.array(spans[at, 0] - base[at]), pa.array(spans[at, 1] - base[at])], names=["start", "end"]
            )
            counts = np.concatenate([[0], np.cumsum(loss)])[cuts]
            buffers = [None, pa.py_buffer(edges[cuts].astype(np.int32).tobytes()), pa.py_buffer(data)]
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(first)),
                    batch.column("turn").take(pa.array(first)),
                    pa.array(np.arange(piece, piece + len(first))),
                    pa.Array.from_buffers(pa.binary(), len(first), buffers),
                    pa.ListArray.from_arrays(pa.array(counts.astype(np.int32)), struct),
                ],
                names=["conv_id", "first_turn", "piece", "formatted", "loss"],
            )
            piece += len(first)

    return rows.mapInArrow(run, PIECES.format(kind=kinds["conv_id"], turn=kinds["turn"]))


def turns_of(data: bytes) -> list[tuple[bytes, bytes]]:
    """(role, text) of each formatted turn."""
    out = []
    for turn in data.split(START)[1:]:
        role, _, text = turn.partition(b"\n")
        out.append((unescaped(role.replace(LINE, b"\n")), unescaped(text[: -len(END)])))
    return out


def code_points(data: bytes) -> int:
    return len(data) - len(data.translate(None, bytes(b for b in range(256) if not 0x80 <= b < 0xC0)))


class Digest:
    """What is read back of one conversation, piece by piece."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, data: bytes, loss: list[tuple[int, int]]) -> None:
        for role, text in turns_of(data):
            self.turns += 1
            self.all.update(b"%b\n%b\n" % (role, text))
        for start, end in loss:
            text = unescaped(data[start:end])
            self.loss_chars += code_points(text)
            self.loss.update(text)
        self.chars += code_points(data)

    def row(self) -> list:
        return [self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars]


DIGESTS = "conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(pieces: DataFrame) -> DataFrame:
    """One row per conversation from its formatted pieces: counts and digests of turns and of loss texts.

    A digest runs over a conversation in order, so one task streams it; only a hash state is kept.
    """
    bounded_batches(pieces.sparkSession)
    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "first_turn", "piece")
    names = "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars".split()

    def run(batches):
        now: Digest | None = None
        for batch in batches:
            kinds = [batch.schema.field("conv_id").type, *map(pa.type_for_alias, "int64 string int64 string int64".split())]
            done = []
            for conv_id, data, loss in zip(
                batch.column("conv_id").to_pylist(), batch.column("formatted").to_pylist(), batch.column("loss").to_pylist()
            ):
                if now is None or conv_id != now.conv_id:
                    if now is not None:
                        done.append(now.row())
                    now = Digest(conv_id)
                now.add(data, [(s["start"], s["end"]) for s in loss])
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(now.row(), kinds)], names=names)

    return ordered.mapInArrow(run, DIGESTS.format(kind=dict(pieces.dtypes)["conv_id"]))
