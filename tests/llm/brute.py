"""Brute-force versions of the operators, on plain Python rows."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np

UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def repeated(rows: list[tuple], window: int) -> list[list[bool]]:
    """For each (doc_id, text), which words a window covers that a smaller doc_id has."""
    first: dict[tuple, int] = {}
    for doc, text in rows:
        w = words(text)
        for s in range(len(w) - window + 1) if doc is not None else ():
            k = tuple(w[s : s + window])
            first[k] = min(first.get(k, doc), doc)
    out = []
    for doc, text in rows:
        w = words(text)
        hit = [False] * len(w)
        for s in range(len(w) - window + 1) if doc is not None else ():
            if first[tuple(w[s : s + window])] < doc:
                hit[s : s + window] = [True] * window
        out.append(hit)
    return out


def digests(rows: list[tuple], window: int) -> list[tuple]:
    out = []
    for (doc, text), hit in zip(rows, repeated(rows, window), strict=True):
        kept = b" ".join(w for w, h in zip(words(text), hit, strict=True) if not h)
        out.append((doc, len(hit), sum(hit), hashlib.sha256(kept).hexdigest()))
    return out


def shingles(text: str | None, k: int) -> frozenset:
    w = (text or "").encode().translate(UPPER).split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def roots(nodes, links) -> dict:
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def jaccard_components(rows: list[tuple], k: int, percent: int) -> list[tuple]:
    sets = [(d, shingles(t, k)) for d, t in rows]
    holders = defaultdict(list)
    links = []
    for i, (d, s) in enumerate(sets):
        if d is None:
            continue
        both = Counter(j for g in s for j in holders[g])
        links += [(d, sets[j][0]) for j, n in both.items() if 100 * n >= percent * (len(s) + len(sets[j][1]) - n)]
        for g in s:
            holders[g].append(i)
    root = roots({d for d, _ in sets if d is not None}, links)
    return [(d, len(s), None if d is None else root[d]) for d, s in sets]


def usable(v) -> bool:
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)


def cosine_links(rows: list[tuple], least: float) -> list[tuple]:
    good = sorted({(i, tuple(v)) for i, v in rows if i is not None and usable(v)})
    links, n = [], Counter()
    for a in range(len(good)):
        for b in range(a + 1, len(good)):
            (i, u), (j, v) = good[a], good[b]
            if len(u) == len(v) and i != j:
                u, v = np.array(u, float), np.array(v, float)
                if u @ v / (np.sqrt(u @ u) * np.sqrt(v @ v)) >= least:
                    links.append((i, j))
                    n[i] += 1
                    n[j] += 1
    root = roots({i for i, _ in rows if i is not None}, links)
    return [(i, n[i], root.get(i), i is not None and root[i] == i) for i, _ in rows]
