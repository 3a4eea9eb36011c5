"""Plain restatements of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def op1(docs, width=200):
    texts = [(d, (t or "").encode()) for d, t in docs]
    seen = Counter(t[i : i + width] for _, t in texts for i in range(len(t) - width + 1))
    out = []
    for d, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def op5(docs, width=50):
    words = [(d, WORD.findall(t or "")) for d, t in docs]
    least = defaultdict(lambda: float("inf"))
    for d, w in words:
        for i in range(len(w) - width + 1):
            g = tuple(w[i : i + width])
            least[g] = min(least[g], d)
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if least[tuple(w[i : i + width])] < d:
                gone[i : i + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def op9(docs, n=3, share=(90, 100)):
    sets = {}
    for d, t in docs:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(t or "")]
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    by = defaultdict(list)
    for d in ids:
        for g in sets[d]:
            by[g].append(d)
    pairs = Counter()
    for m in by.values():
        for i, a in enumerate(m):
            for b in m[i + 1 :]:
                pairs[a, b] += 1
    for (a, b), both in pairs.items():
        if share[1] * both >= share[0] * (len(sets[a]) + len(sets[b]) - both):
            ra, rb = sorted((root(a), root(b)))
            parent[rb] = ra
    return [(d, len(sets[d]), root(d)) for d in ids]
