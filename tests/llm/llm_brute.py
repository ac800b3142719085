"""Plain versions of the operators over rows (doc_id, text)."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

LOWER = {c: c + 32 for c in range(65, 91)}


def crc(doc_id) -> int:
    return zlib.crc32(str(doc_id).encode())


def spaced_words(text):
    return re.findall("[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def alnum_words(text):
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def removed_strings(rows, width=50):
    low = lambda d: -1 if d is None else d
    first: dict[bytes, int] = {}
    for d, t in sorted(rows, key=lambda r: low(r[0])):
        b = (t or "").encode()
        for i in range(len(b) - width + 1):
            first.setdefault(b[i:i + width], low(d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if first[b[i:i + width]] < low(d):
                gone[i:i + width] = b"\1" * width
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def shingle_set(text, n=5):
    w = spaced_words(text)
    if len(w) < n:
        return {tuple(w)} if w else set()
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}


def link_components(rows, percent=80):
    sets = {d: shingle_set(t) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def deduped_lines(rows, min_chars=40, min_docs=5):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    found = defaultdict(set)
    for d, t in set(rows):
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                found[key(line)].add((d, t))
    low = lambda d: -1 if d is None else d
    last = {k: max(low(d) for d, _ in v) for k, v in found.items() if len(v) >= min_docs}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if last.get(key(x), low(d)) == low(d)]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def contaminated(rows, items, window=10):
    windows = defaultdict(set)
    for item, text in items:
        w = alnum_words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[i:i + n])].add(item)
    out = []
    for d, t in rows:
        w = alnum_words(t)
        hit, found = [False] * len(w), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit[i:i + n] = [True] * n
                    found |= windows[tuple(w[i:i + n])]
        out.append((d, len(w), sum(hit), sorted(str(x) for x in found if x is not None)))
    return out


def partial_matching(rows, order=5):
    """doc_id -> n_tokens, n_known, train_tokens, base_score, score."""
    words, norm = Counter(), {}
    tables = [defaultdict(Counter) for _ in range(order + 1)]
    for d, t in rows:
        w = spaced_words(t)
        b = b"\n" * order + "".join(x + " " for x in w).encode() + b"\n"
        norm[d] = (w, b)
        if crc(d) % 7 != 2:
            words.update(w)
            words[None] += 1
            for i in range(order, len(b)):
                for k in range(order + 1):
                    tables[k][b[i - k:i]][b[i]] += 1
    n, v, out = sum(words.values()), len(words), {}
    for d, (w, b) in norm.items():
        score = 0.0
        for i in range(order, len(b)):
            gone: set = set()
            for k in range(order, -1, -1):
                c = {x: m for x, m in tables[k].get(b[i - k:i], {}).items() if x not in gone}
                if not c:
                    continue
                total, kinds = sum(c.values()), len(c)
                if b[i] in c:
                    score += math.log10(c[b[i]] / (total + kinds))
                    break
                score += math.log10(kinds / (total + kinds))
                gone |= set(c)
            else:
                score -= math.log10(256 - len(gone))
        tokens = [*w, None]
        base = sum(math.log10((words[x] + 1) / (n + v + 1)) for x in tokens)
        out[d] = (len(tokens), sum(words[x] > 0 for x in tokens), n, base, score)
    return out
