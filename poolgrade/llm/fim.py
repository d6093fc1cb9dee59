"""Fill-in-middle transformation by displacement scatter, and its inverse by gather.

A text is cut into units (a word with the blanks before it; blanks at the end). Two hash draws choose how many
units make the prefix and how many the middle; the rest is the suffix. Forms: ``plain`` is the text, ``psm`` is
``<P>`` prefix ``<S>`` suffix ``<M>`` middle, ``spm`` is ``<S>`` suffix ``<P>`` prefix ``<M>`` middle. Texts that
are empty or hold one of the three marks stay plain.

All texts of a batch lie in one byte buffer. Cuts are found by scanning it; at each cut a difference array says by
how much the following bytes are displaced more than those before it, its running sum gives every byte its
place in the output buffer, and one scatter moves them. For the way back the marks are scanned in the output, the
same displacements follow from their places, and a gather reads the text. Both go through the buffer in
blocks, so besides texts and outputs the memory is constant.

Null texts count as empty, a null id as an empty string of digits; equal rows get equal results; other columns stay,
one called like the result gives way. `restored` gives null for a null form, a null output, or an output that its
form could not have made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import bounded_batches, fresh, give_back, slices, without
from .words import flat_bytes

# The marks, and the blanks of the unit pattern.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
BLANKS = b" \t\n\v\f\r"
FORMS = ("plain", "psm", "spm")
MARK = 3  # bytes of a mark

SEED = 42
MOVED_PERCENT = 50  # of texts that are not left plain
SUFFIX_FIRST_PERCENT = 80  # of those, texts that begin with the suffix
BLOCK = 1 << 20  # bytes moved at once

_BLANK = np.zeros(256, bool)
_BLANK[list(BLANKS)] = True


def draws(doc_id: Column, seed: int = SEED) -> Column:
    """Four unsigned 32-bit numbers from the sha256 of ``seed:id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)])


def unit_ends(flat: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where units end, in a buffer of texts that begin at ``edges``."""
    blank = _BLANK[flat]
    ends = np.zeros(len(flat) + 1, bool)
    ends[1:-1] = ~blank[:-1] & blank[1:]
    ends[edges[1:][np.diff(edges) > 0]] = True
    return np.flatnonzero(ends)


def marks(flat: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the marks that lie inside a text, their letters, and the numbers of their texts."""
    if len(flat) < MARK:
        return (np.zeros(0, np.int64),) * 3
    at = np.flatnonzero(flat[: -(MARK - 1)] == PREFIX[0])
    letter = flat[at + 1]
    at = at[(flat[at + 2] == PREFIX[2]) & np.isin(letter, [m[1] for m in (PREFIX, SUFFIX, MIDDLE)])]
    row = np.searchsorted(edges, at, side="right") - 1
    inside = at + MARK <= edges[row + 1]
    return at[inside], flat[at[inside] + 1], row[inside]


def displacements(
    edges: np.ndarray, out_edges: np.ndarray, p: np.ndarray, q: np.ndarray, form: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Where the displacement of the following bytes changes, and by how much.

    Text k lies at ``edges[k]`` and is cut at ``p[k]`` and ``q[k]``; its output lies at ``out_edges[k]``.
    """
    start, end, to = edges[:-1], edges[1:], out_edges[:-1]
    prefix, middle, suffix = p - start, q - p, end - q
    moved = form > 0
    spm = form == 2
    first = to + np.where(moved, np.where(spm, suffix + 2 * MARK, MARK), 0)
    last = to + np.where(moved, np.where(spm, MARK, prefix + 2 * MARK), prefix + middle)
    inner = to + np.where(moved, prefix + suffix + 3 * MARK, prefix)
    by = np.stack([first - start, inner - p, last - q], axis=1).ravel()
    at = np.stack([start, p, q], axis=1).ravel()
    return at, np.diff(by, prepend=0)


def places(at: np.ndarray, change: np.ndarray, n: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Blocks of the buffer of ``n`` bytes, and where each of their bytes goes."""
    before = 0
    for a in range(0, n, BLOCK):
        b = min(n, a + BLOCK)
        lo, hi = np.searchsorted(at, [a, b])
        difference = np.zeros(b - a, np.int64)
        np.add.at(difference, at[lo:hi] - a, change[lo:hi])
        difference[0] += before
        shift = np.cumsum(difference)
        before = shift[-1]
        shift += np.arange(a, b)
        yield a, b, shift


def mark_places(out_edges: np.ndarray, prefix: np.ndarray, suffix: np.ndarray, form: np.ndarray) -> dict[bytes, np.ndarray]:
    """Where the marks stand in the outputs that have them."""
    to, spm = out_edges[:-1], form == 2
    at = {
        PREFIX: np.where(spm, to + MARK + suffix, to),
        SUFFIX: np.where(spm, to, to + MARK + prefix),
        MIDDLE: to + 2 * MARK + prefix + suffix,
    }
    return {mark: places[form > 0] for mark, places in at.items()}


def assembled(texts: pa.Array, drawn: np.ndarray, moved_percent: int, suffix_first_percent: int):
    """Units, forms, characters of prefixes and middles, and outputs (buffer and edges) of a batch.

    ``drawn`` has four numbers per text.
    """
    flat, edges = flat_bytes(texts)
    ends = unit_ends(flat, edges)
    first = np.searchsorted(ends, edges[:-1], side="right")
    n = np.searchsorted(ends, edges[1:], side="right") - first
    form = np.where(drawn[:, 3] % 100 < suffix_first_percent, 2, 1)
    form[(drawn[:, 2] % 100 >= moved_percent) | (np.diff(edges) == 0)] = 0
    form[marks(flat, edges)[2]] = 0

    units = np.sort(drawn[:, :2] % (n + 1)[:, None], axis=1)
    bounds = np.concatenate([[0], ends])
    cuts = [np.where(u == 0, edges[:-1], bounds[first + u]) for u in units.T]
    p, q = (np.where(form > 0, c, edges[:-1]) for c in cuts)

    out_edges = edges + np.concatenate([[0], np.cumsum(np.where(form > 0, 3 * MARK, 0))])
    out = np.empty(out_edges[-1], np.uint8)
    for a, b, to in places(*displacements(edges, out_edges, p, q, form), len(flat)):
        out[to] = flat[a:b]
    for mark, at in mark_places(out_edges, p - edges[:-1], edges[1:] - q, form).items():
        out[at[:, None] + np.arange(MARK)] = np.frombuffer(mark, np.uint8)

    inner = np.flatnonzero((flat & 0xC0) == 0x80)  # bytes that do not begin a character

    def characters(a, b):
        return (b - a) - (np.searchsorted(inner, b) - np.searchsorted(inner, a))

    return n, form, characters(edges[:-1], p), characters(p, q), out, out_edges


def gathered(outputs: pa.Array, form: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts (buffer and edges) from outputs and their forms, and which of them are sound."""
    flat, out_edges = flat_bytes(outputs)
    at, letter, row = marks(flat, out_edges)
    count = np.bincount(row, minlength=len(form))
    first = np.cumsum(count) - count
    sound = (form == 0) | (count == 3)
    form = np.where(sound, form, 0)
    moved = np.flatnonzero(form > 0)
    three = first[moved, None] + np.arange(3)
    order = {1: PREFIX + SUFFIX + MIDDLE, 2: SUFFIX + PREFIX + MIDDLE}
    expected = np.array([[0] * 3] + [list(order[k][1::MARK]) for k in (1, 2)])
    right = (letter[three] == expected[form[moved]]).all(axis=1) & (at[three[:, 0]] == out_edges[moved])
    sound[moved[~right]] = False
    form[moved[~right]] = 0
    moved, three = moved[right], three[right]

    edges = out_edges - np.concatenate([[0], np.cumsum(np.where(form > 0, 3 * MARK, 0))])
    spot, ends = at[three], out_edges[1:][moved]
    one = spot[:, 1] - spot[:, 0] - MARK
    two = spot[:, 2] - spot[:, 1] - MARK
    middle = ends - spot[:, 2] - MARK
    prefix = np.where(form[moved] == 2, two, one)
    p, q = edges[:-1].copy(), edges[:-1].copy()
    p[moved] += prefix
    q[moved] += prefix + middle
    text = np.empty(edges[-1], np.uint8)
    for a, b, to in places(*displacements(edges, out_edges, p, q, form), len(text)):
        text[a:b] = flat[to]
    return text, edges, sound


def _strings(data: np.ndarray, edges: np.ndarray, kept: np.ndarray | None = None) -> pa.Array:
    column = pa.Array.from_buffers(
        pa.large_string(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int64).tobytes()), pa.py_buffer(data)]
    ).cast(pa.string())
    if kept is None or kept.all():
        return column
    return column.take(pa.array(np.arange(len(column)), mask=~kept))


RESULT = T.StructType(
    [
        T.StructField("n", T.LongType()),
        T.StructField("form", T.StringType()),
        T.StructField("prefix_chars", T.LongType()),
        T.StructField("middle_chars", T.LongType()),
        T.StructField("output", T.StringType()),
    ]
)


def transformed(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    column: str = "fim",
    seed: int = SEED,
    moved_percent: int = MOVED_PERCENT,
    suffix_first_percent: int = SUFFIX_FIRST_PERCENT,
) -> DataFrame:
    """``df`` with a struct: units of the text, form, characters of prefix and middle (null if plain), output."""
    bounded_batches(df.sparkSession)
    drawn = fresh(df, "drawn")
    df = df.withColumn(drawn, draws(F.col(doc_id), seed))
    df = without(df, column)
    names, at = df.columns, df.columns.index(text)
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    struct = [pa.field(f.name, k) for f, k in zip(RESULT.fields, kinds)]

    def run(batches):
        for batch in batches:
            done = 0
            for texts in slices(batch.column(at)):
                part = batch.slice(done, len(texts))
                done += len(texts)
                four = part.column(drawn).flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)
                n, form, prefix, middle, out, edges = assembled(texts, four, moved_percent, suffix_first_percent)
                values = [
                    pa.array(n),
                    pa.array(np.array(FORMS, object)[form]),
                    pa.array(prefix, mask=form == 0),
                    pa.array(middle, mask=form == 0),
                    _strings(out, edges),
                ]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.StructArray.from_arrays(values, fields=struct)], names=[*names, column])
        give_back()

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(column, RESULT)])).drop(drawn)


def restored(df: DataFrame, output: str = "output", form: str = "form", column: str = "text") -> DataFrame:
    """``df`` with the text that the outputs of `transformed` were made from, found from output and form alone."""
    bounded_batches(df.sparkSession)
    df = without(df, column)
    names, at, of = df.columns, df.columns.index(output), df.columns.index(form)

    def run(batches):
        for batch in batches:
            done = 0
            for outputs in slices(batch.column(at)):
                part = batch.slice(done, len(outputs))
                done += len(outputs)
                codes = np.array([FORMS.index(f) if f in FORMS else -1 for f in part.column(of).to_pylist()], np.int64)
                text, edges, sound = gathered(outputs, np.maximum(codes, 0))
                sound &= (codes >= 0) & outputs.is_valid().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([*part.columns, _strings(text, edges, sound)], names=[*names, column])
        give_back()

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(column, T.StringType())]))
