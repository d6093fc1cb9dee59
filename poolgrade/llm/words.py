"""Texts as numbered stretches between blanks, so that work is done once for each different stretch."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Unicode white space.
SPACE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
LOOSE = SPACE + " "
WHOLE_CHARS = 1 << 20


@dataclass
class Stretches:
    """Stretch numbers of all texts in a row, where each text begins, and the different stretches.

    The first stretches follow a blank, which belongs to them; the others begin a text, or are whole texts that
    blanks do not cut safely or that are very long.
    """

    codes: np.ndarray
    edges: np.ndarray
    after: pa.Array  # the first stretches, without the blank before them
    others: list[str]

    @property
    def spaced(self) -> int:
        return len(self.after)


def stretches(texts: pa.Array) -> Stretches:
    """Cut texts before each blank that follows a non-blank (nulls count as empty)."""
    texts = pc.fill_null(texts, "")
    odd = pc.or_(pc.match_substring_regex(texts, LOOSE), pc.greater(pc.utf8_length(texts), WHOLE_CHARS))
    split = pc.split_pattern(pc.if_else(odd, "", texts), " ")
    parts, edges = split.flatten(), split.offsets.to_numpy().astype(np.int64)
    edges -= edges[0]
    first = np.zeros(len(parts), bool)
    first[edges[:-1]] = True
    rest = parts.filter(pa.array(~first)).dictionary_encode()
    lead = parts.filter(pa.array(first)).dictionary_encode()
    spaced, n_lead = len(rest.dictionary), len(lead.dictionary)
    codes = np.empty(len(parts), np.int64)
    codes[~first] = rest.indices.to_numpy()
    codes[first] = lead.indices.to_numpy() + spaced
    alone = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
    codes[edges[alone]] = spaced + n_lead + np.arange(len(alone))
    return Stretches(codes, edges, rest.dictionary, listed(lead.dictionary) + listed(texts.filter(odd)))


def listed(strings: pa.Array) -> list[str]:
    """`to_pylist` by way of numpy, which is several times faster."""
    return strings.to_numpy(zero_copy_only=False).tolist()


def gathered(cut: Stretches, flat: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All texts' numbers in a row, and where each text's begin.

    The numbers of stretch k are the ``sizes[k]`` of ``flat`` from ``places[k]`` on.
    """
    counts = sizes[cut.codes]
    ends = np.concatenate([[0], np.cumsum(counts)])
    at = np.repeat(places[cut.codes] - ends[:-1], counts)
    at += np.arange(ends[-1])
    return flat[at], ends[cut.edges]


def unpacked(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed 32-bit numbers of each stretch, as `gathered` takes them."""
    sizes = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
    return np.frombuffer(b"".join(ids), "<u4"), sizes, np.cumsum(sizes) - sizes


def binaries(numbers: np.ndarray, edges: np.ndarray) -> pa.Array:
    """Each text's numbers as little-endian 32-bit binary, without copying."""
    offsets = pa.py_buffer((edges * 4).astype(np.int64).tobytes())
    data = pa.py_buffer(numbers.astype("<u4").tobytes())
    return pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, offsets, data]).cast(pa.binary())


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row and where each begins (nulls count as empty)."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return flat[edges[0] : edges[-1]], edges - edges[0]


def split_words(texts: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Word numbers of all texts in a row, where each text's begin, and the different words.

    ``table`` maps each byte to another or to a blank; bytes from 0x80 on must stay.
    """
    flat, edges = flat_bytes(texts)
    buffers = [None, pa.py_buffer(edges.astype(np.int64).tobytes()), pa.py_buffer(table[flat].tobytes())]
    mapped = pa.Array.from_buffers(pa.large_string(), len(texts), buffers)
    split = pc.split_pattern(mapped, " ")
    parts = split.flatten().dictionary_encode()
    starts = split.offsets.to_numpy().astype(np.int64)
    starts -= starts[0]
    words = listed(parts.dictionary)
    codes = parts.indices.to_numpy().astype(np.int64)
    if "" in words:
        empty = words.index("")
        there = codes != empty
        starts = np.concatenate([[0], np.cumsum(there)])[starts]
        codes = codes[there]
    return codes, starts, words


def byte_table(keep: str, lower: bool) -> np.ndarray:
    """A table for `split_words`: the ASCII characters ``keep`` and all other bytes stay, the rest are blanks."""
    out = np.full(256, 0x20, np.uint8)
    out[0x80:] = np.arange(0x80, 0x100)
    for c in keep.encode():
        out[c] = c + 32 if lower and 0x41 <= c <= 0x5A else c
    return out
