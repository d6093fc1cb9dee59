"""md5 of many short texts at once, in numpy: the draws of starts and resamples take dozens of digests per row."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

MOST = 55  # bytes of a message of one block; longer ones are digested one by one
CHUNK = 8192  # rows whose state is held at once
_TURNS = np.repeat([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], 4, axis=0).reshape(4, 4, 4)
_SINES = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2.0**32).astype(np.uint64).astype(np.uint32)
_FIRST = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


class Texts:
    """Texts laid out once for digests under many prefixes; nulls count as empty and are marked in ``null``."""

    def __init__(self, column: pa.Array):
        self.null = column.is_null().to_numpy(zero_copy_only=False)
        self.raw = [b"" if t is None else t.encode() for t in column.to_pylist()]
        self.size = np.array([len(t) for t in self.raw], np.int64)
        self.width = min(MOST, int(self.size.max(initial=0)))
        self.bytes = np.zeros((len(self.raw), self.width), np.uint8)
        short = self.size <= self.width
        data = np.frombuffer(b"".join(t for t in self.raw if len(t) <= self.width), np.uint8)
        self.bytes[(np.arange(self.width) < self.size[:, None]) & short[:, None]] = data

    def md5(self, prefix: bytes) -> np.ndarray:
        """Digests of prefix and text, as four big-endian words (four, rows)."""
        out = np.empty((4, len(self.raw)), np.uint32)
        for at in range(0, len(self.raw), CHUNK):
            some = slice(at, at + CHUNK)
            size = self.size[some] + len(prefix)
            rows = len(size)
            block = np.zeros((rows, 64 + self.width + len(prefix)), np.uint8)  # room for texts that are digested below
            block[:, : len(prefix)] = np.frombuffer(prefix, np.uint8)
            block[:, len(prefix) : len(prefix) + self.width] = self.bytes[some]
            block[np.arange(rows), np.minimum(size, MOST)] = 0x80
            block = np.ascontiguousarray(block[:, :64])
            block[:, 56:64] = (size * 8).astype("<u8").view(np.uint8).reshape(rows, 8)
            out[:, some] = _one_block(np.ascontiguousarray(block.view("<u4").T))
            for i in np.flatnonzero(size > MOST):
                out[:, at + i] = np.frombuffer(hashlib.md5(prefix + self.raw[at + i], usedforsecurity=False).digest(), ">u4")
        return out


def _one_block(words: np.ndarray) -> np.ndarray:
    a, b, c, d = (np.full(words.shape[1], v, np.uint32) for v in _FIRST)
    f, t = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        turn = i // 16
        if turn == 0:  # d ^ (b & (c ^ d))
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
            word = i
        elif turn == 1:  # c ^ (d & (b ^ c))
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
            word = (5 * i + 1) % 16
        elif turn == 2:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
            word = (3 * i + 5) % 16
        else:  # c ^ (b | ~d)
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
            word = 7 * i % 16
        f += a
        f += _SINES[i]
        f += words[word]
        by = int(_TURNS[turn, 0, i % 4])
        np.left_shift(f, np.uint32(by), out=t)
        np.right_shift(f, np.uint32(32 - by), out=f)
        f |= t
        f += b
        a, b, c, d, f = d, f, b, c, a
    return np.stack([(v + np.uint32(first)).byteswap() for v, first in zip((a, b, c, d), _FIRST)])


def digits(words: np.ndarray, start: int, count: int) -> np.ndarray:
    """Hex digits ``start`` to ``start + count`` (eight at most) of the digests as a number; those past the end are left out."""
    count = max(0, min(count, 32 - start))
    if not count:
        return np.zeros(words.shape[1], np.int64)
    at, skip = divmod(start, 8)
    pair = words[at].astype(np.uint64) << np.uint64(32)
    if at < 3:
        pair |= words[at + 1]
    return ((pair << np.uint64(4 * skip)) >> np.uint64(64 - 4 * count)).astype(np.int64)
