"""Similarity of many pairs of texts by their longest matching blocks, whole batches at a time.

The measure is twice the matched characters over all characters. The longest common block of two texts matches (of
equal ones the first in the first text, then the first in the second); then the parts before it and after it are
compared likewise. Here a round finds the longest block of every open pair of parts at once, by run lengths along the
second texts, so a batch takes as many rounds as its deepest pair.

In a second text of ``LONG`` characters or more, a character that makes up more than a hundredth of it (and one more)
starts no block; blocks found without such characters grow over them at both ends.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

LONG = 200
CELLS = 1 << 21  # run lengths held at once
NO_LEFT, NO_RIGHT = -1, -2  # beyond a text's end; they match nothing


def _padded(texts: Sequence[str], fill: int) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(t) for t in texts], np.int64)
    out = np.full((len(texts), int(sizes.max(initial=0)) + 1), fill, np.int32)
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.int32)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out, sizes


def _popular(b: np.ndarray, sizes: np.ndarray) -> np.ndarray | None:
    """Places of long second texts whose characters start no block."""
    out = None
    for row in np.flatnonzero(sizes >= LONG):
        text = b[row, : sizes[row]]
        values, inverse, counts = np.unique(text, return_inverse=True, return_counts=True)
        often = counts > sizes[row] // 100 + 1
        if often.any():
            out = np.zeros(b.shape, bool) if out is None else out
            out[row, : sizes[row]] = often[inverse]
    return out


def _longest(a: np.ndarray, b: np.ndarray, popular: np.ndarray | None, parts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start in a, start in b, size) of the longest block of each part (pair, a from, a to, b from, b to)."""
    row, a0, a1, b0, b1 = parts.T
    wide = int((b1 - b0).max())
    spots = b0[:, None] + np.arange(wide)
    inside = spots < b1[:, None]
    spots = np.minimum(spots, b.shape[1] - 1)
    letters = np.where(inside, b[row[:, None], spots], NO_RIGHT)
    starts = letters if popular is None else np.where(popular[row[:, None], spots], NO_RIGHT, letters)
    runs = np.zeros((len(parts), wide + 1), np.int32)
    best_a, best_b, best = a0.copy(), b0.copy(), np.zeros(len(parts), np.int64)
    for step in range(int((a1 - a0).max())):
        at = a0 + step
        letter = np.where(at < a1, a[row, np.minimum(at, a.shape[1] - 1)], NO_LEFT)
        runs[:, 1:] = np.where(starts == letter[:, None], runs[:, :-1] + 1, 0)
        place = runs[:, 1:].argmax(axis=1)
        size = runs[np.arange(len(parts)), place + 1]
        more = size > best
        best[more] = size[more]
        best_a[more] = (at - size + 1)[more]
        best_b[more] = (b0 + place - size + 1)[more]
    if popular is not None:
        while (grow := (best_a > a0) & (best_b > b0) & (a[row, best_a - 1] == b[row, best_b - 1])).any():
            best_a, best_b, best = best_a - grow, best_b - grow, best + grow
        while True:
            end_a, end_b = best_a + best, best_b + best
            same = a[row, np.minimum(end_a, a.shape[1] - 1)] == b[row, np.minimum(end_b, b.shape[1] - 1)]
            grow = (end_a < a1) & (end_b < b1) & same
            if not grow.any():
                break
            best = best + grow
    return best_a, best_b, best


def _matched(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Matched characters of each pair."""
    out = np.zeros(len(a), np.int64)
    popular = _popular(b, lb)
    parts = np.stack([np.arange(len(a)), np.zeros_like(la), la, np.zeros_like(lb), lb], axis=1)
    parts = parts[(la > 0) & (lb > 0)]
    while len(parts):
        wide = max(1, int((parts[:, 4] - parts[:, 3]).max()))
        found = [
            np.stack(_longest(a, b, popular, parts[at : at + max(1, CELLS // wide)]), axis=1)
            for at in range(0, len(parts), max(1, CELLS // wide))
        ]
        i, j, size = np.concatenate(found).T
        out += np.bincount(parts[:, 0], size, len(out)).astype(np.int64)
        row, a0, a1, b0, b1 = parts.T
        before = np.stack([row, a0, i, b0, j], axis=1)
        after = np.stack([row, i + size, a1, j + size, b1], axis=1)
        parts = np.concatenate([before[size > 0], after[size > 0]])
        parts = parts[(parts[:, 2] > parts[:, 1]) & (parts[:, 4] > parts[:, 3])]
    return out


def ratios(first: Sequence[str], second: Sequence[str]) -> np.ndarray:
    """The measure of each pair, 1 for two empty texts. Pairs of like size are compared together."""
    la, lb = (np.array([len(t) for t in side], np.int64) for side in (first, second))
    out = np.ones(len(la))
    size = np.maximum(la, lb)
    kind = np.ceil(np.log2(size + 1)).astype(int)
    for k in np.unique(kind):
        mine = np.flatnonzero(kind == k)
        many = max(1, CELLS // (1 << int(k)))
        for some in (mine[at : at + many] for at in range(0, len(mine), many)):
            a, sa = _padded([first[i] for i in some], NO_LEFT)
            b, sb = _padded([second[i] for i in some], NO_RIGHT)
            total = sa + sb
            out[some] = np.where(total > 0, 2.0 * _matched(a, sa, b, sb) / np.maximum(total, 1), 1.0)
    return out
