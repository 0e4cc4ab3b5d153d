"""Plain versions to test against."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np


def usable(v):
    return v is not None and len(v) == 128 and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)


def unit(v):
    x = np.array(v, np.float32).astype(np.float64)
    x /= np.abs(x).max()
    return x / np.sqrt((x * x).sum())


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def alike_pairs(rows):
    out = set()
    vs = {r[0]: unit(r[1]) for r in rows if usable(r[1])}
    ws = {r[0]: Counter(words(r[2])) for r in rows if len(words(r[2])) >= 8}
    ids = sorted(r[0] for r in rows)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if a in vs and b in vs and round(float(vs[a] @ vs[b]), 6) >= 0.98:
                out.add((a, b))
            elif a in ws and b in ws and 5 * sum((ws[a] & ws[b]).values()) >= 4 * max(ws[a].total(), ws[b].total()):
                out.add((a, b))
    return out


def grouped(pairs):
    parent: dict[int, int] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def refused(pairs):
    before: dict[int, list[int]] = {}
    for a, b in pairs:
        before.setdefault(b, []).append(a)
    out: dict[int, int] = {}
    for b in sorted(before):
        kept = [a for a in before[b] if a not in out]
        if kept:
            out[b] = min(kept)
    return out


def cosines(rows):
    vs = [(r[0], unit(r[1])) for r in rows if usable(r[1])]
    ids = [i for i, _ in vs]
    x = np.stack([v for _, v in vs])
    return ids, np.round(x @ x.T, 6)
