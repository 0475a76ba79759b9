"""Plain versions of the corpus operators, for small tables."""

import hashlib
import math
from collections import Counter, defaultdict

SPACE = " \t\n\x0b\x0c\r"


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text)


def words(text):
    out = [""]
    for c in text or "":
        if c in SPACE:
            out.append("")
        else:
            out[-1] += c
    return [lower(w) for w in out if w]


def shingles(text, n=5):
    w = words(text)
    if not w:
        return set()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or {tuple(w)}


def classes(rows):
    """rows: (doc_id, text).  {doc_id: (n_shingles, component_id)}"""
    sets = {d: shingles(t) for d, t in rows}
    by = defaultdict(set)
    for d, s in sets.items():
        for x in s:
            by[x].add(d)
    common = Counter()
    for ds in by.values():
        ds = sorted(ds)
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                common[a, b] += 1
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), i in common.items():
        if 100 * i >= 80 * (len(sets[a]) + len(sets[b]) - i):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def repeats(rows, length=50):
    """rows: (doc_id, text).  {doc_id: (n_bytes, n_removed, n_spans, kept_sha256)}"""
    first, out = {}, {}
    data = {d: (t or "").encode() for d, t in rows}
    for d in sorted(data):
        raw = data[d]
        for i in range(len(raw) - length + 1):
            first.setdefault(raw[i : i + length], d)
    for d, raw in data.items():
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if first[raw[i : i + length]] < d:
                gone[i : i + length] = b"\x01" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out[d] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def line_dedup(rows, least_chars=40, least_docs=5):
    key = lambda line: lower(line.strip(SPACE))
    held = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least_chars:
                held[key(line)].add(d)
    out = {}
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(held.get(key(x), ())) >= least_docs and d != max(held[key(x)]))]
        out[d] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def exact(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups["".join(c for c in t or "" if c not in SPACE)].append((-len(t or ""), d))
    out = {}
    for norm, members in groups.items():
        keep = min(members)[1]
        for _, d in members:
            out[d] = (keep, len(members), d == keep, hashlib.sha256(norm.encode()).hexdigest())
    return out


def losses(rows, targets, cls, n_classes, mass):
    """Cross-entropy losses under target and background model; cls: word -> class."""
    docs = {d: words(t) for d, t in rows}
    out = {}
    models = [{d: w for d, w in docs.items() if d in targets}, docs]
    uni = [Counter(cls(w) for ws in m.values() for w in ws) for m in models]
    texts = [sum(1 for ws in m.values() if ws) for m in models]
    pair = [Counter(p for ws in m.values() for p in zip([None, *ws], ws)) for m in models]
    for d, ws in docs.items():
        both = []
        for k, m in enumerate(models):
            own = Counter(zip([None, *ws], ws)) if d in m else Counter()
            own_before = Counter([None, *ws[:-1]]) if d in m else Counter()
            loss = 0.0
            for v, w in zip([None, *ws], ws):
                p1 = (uni[k][cls(w)] + 1) / (sum(uni[k].values()) + n_classes)
                before = max((texts[k] if v is None else uni[k][cls(v)]) - own_before[v], 0)
                loss -= math.log((pair[k][v, w] - own[v, w] + mass * p1) / (before + mass))
            both.append(loss / len(ws) if ws else None)
        out[d] = (len(ws), *both)
    return out
