"""Plain versions of the operators, for small inputs."""

import collections
import hashlib
import re

import xxhash

LOWER = {c: c + 32 for c in range(65, 91)}
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def contamination(docs, items, width=13):
    """doc_id -> (n_words, n_hit, n_items, digest, contaminated)."""
    def split(text):
        return ITEM_WORD.findall((text or "").translate(LOWER))

    windows = collections.defaultdict(set)
    for name, text in items:
        words = split(text)
        n = min(width, len(words))
        for k in range(len(words) - n + 1 if words else 0):
            windows[tuple(words[k : k + n])].add(name)
    out = {}
    for doc, text in docs:
        words = split(text)
        hit, found = [False] * len(words), set()
        for n in {len(w) for w in windows}:
            for k in range(len(words) - n + 1):
                names = windows.get(tuple(words[k : k + n]))
                if names:
                    found |= names
                    hit[k : k + n] = [True] * n
        found = sorted(str(x) for x in found if x is not None)
        n = sum(hit)
        digest = hashlib.sha256(",".join(found).encode()).hexdigest()
        out[doc] = (len(words), n, len(found), digest, n > 0 and 20 * n >= len(words))
    return out


def fingerprint(text, size=4):
    words = WORD.findall((text or "").translate(LOWER))
    parts = [" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, distance=4):
    """key -> least key reachable through fingerprints (key -> bits) at most ``distance`` apart."""
    keys = sorted(prints)
    root = {k: k for k in keys}
    for k in keys:  # spread from each unvisited key
        if root[k] != k:
            continue
        queue, seen = [k], {k}
        while queue:
            at = queue.pop()
            for other in keys:
                if other not in seen and (prints[at] ^ prints[other]).bit_count() <= distance:
                    seen.add(other)
                    queue.append(other)
        for other in seen:
            root[other] = min(seen)
    return root


def repetition(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    times = collections.Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if times[w] > 1 for j in range(5)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
        len(words) < 10 or 100 * len(covered) > 20 * len(words),
    )


def components(edges):
    """node -> least node reachable."""
    near = collections.defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    root = {}
    for start in sorted(near):
        if start in root:
            continue
        queue = [start]
        while queue:
            at = queue.pop()
            if at not in root:
                root[at] = start
                queue.extend(near[at])
    return root
