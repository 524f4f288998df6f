"""Plain versions of the operators for small inputs."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter, defaultdict


def tokens(text):
    return (text or "").encode().split()


def remove_windows(rows, size):
    """Words in windows that also start in a document with a smaller id."""
    least = {}
    for i, text in rows:
        w = tokens(text)
        for p in range(len(w) - size + 1):
            k = tuple(w[p:p + size])
            least[k] = min(least.get(k, i), i)
    out = {}
    for i, text in rows:
        w = tokens(text)
        gone = [False] * len(w)
        for p in range(len(w) - size + 1):
            if least[tuple(w[p:p + size])] < i:
                gone[p:p + size] = [True] * size
        kept = [x for x, g in zip(w, gone) if not g]
        out[i] = (len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def remove_strings(texts, size):
    """Bytes in strings that start twice or more anywhere."""
    raw = [(t or "").encode() for t in texts]
    n = Counter(r[p:p + size] for r in raw for p in range(len(r) - size + 1))
    out = []
    for r in raw:
        gone = [False] * len(r)
        for p in range(len(r) - size + 1):
            if n[r[p:p + size]] > 1:
                gone[p:p + size] = [True] * size
        kept = bytes(b for b, g in zip(r, gone) if not g)
        spans = sum(g and (p == 0 or not gone[p - 1]) for p, g in enumerate(gone))
        out.append((len(r), len(r) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def components(rows, k, percent):
    sets = {i: shingles(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def unigrams(rows, learned):
    n = Counter()
    for i, t in rows:
        if learned(i):
            n.update([*(t or "").encode().lower().split(), "end"])
    total, below = sum(n.values()), sum(n.values()) + 0.1 * (len(n) + 1)
    out = {}
    for i, t in rows:
        w = [*(t or "").encode().lower().split(), "end"]
        out[i] = (len(w), sum(n[x] > 0 for x in w), total, sum(math.log10((n[x] + 0.1) / below) for x in w))
    return out


def crc(i, mod):
    return zlib.crc32(str(i).encode()) % mod


def quality(text):
    text = text or ""
    w = [x.decode() for x in tokens(text)]
    places = defaultdict(list)
    for p in range(len(w) - 7):
        places[tuple(w[p:p + 8])].append(p)
    covered = {p + k for at in places.values() if len(at) > 1 for p in at for k in range(8)}
    lines = [x for x in text.split("\n") if tokens(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def boilerplate(rows, min_sites, min_chars):
    """(doc_id, text, source) -> doc_id: kept text."""
    sites, first = defaultdict(set), {}
    for i, t, s in rows:
        for k, line in enumerate((t or "").split("\n") if t is not None else []):
            x = line.strip(" ")
            if len(x) >= min_chars:
                sites[x] |= {s} - {None}
                first[x] = min(first.get(x, (i, k)), (i, k))
    out = {}
    for i, t, _ in rows:
        keep = [line for k, line in enumerate((t or "").split("\n"))
                if len(sites.get(line.strip(" "), ())) < min_sites or first[line.strip(" ")] == (i, k)]
        out[i] = None if t is None else "\n".join(keep)
    return out
