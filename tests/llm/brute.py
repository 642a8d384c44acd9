"""Plain Python versions of what the operators compute."""

import math
import re
from collections import Counter, defaultdict
from itertools import combinations


def words(text):
    return re.findall(r"[A-Za-z0-9_\u0080-\U0010ffff]+", (text or "").lower())


def shingles(text, n=5):
    w = words(text)
    return [tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, min(len(w), 1)))]


def roots(nodes, pairs):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def similar_pairs(texts, threshold=0.8):
    sets = {d: set(shingles(t)) for d, t in texts.items()}
    return [(a, b) for a, b in combinations(sorted(sets), 2)
            if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold]


def join(texts):
    pairs = similar_pairs(texts)
    links = Counter(x for p in pairs for x in p)
    root = roots(texts, pairs)
    return {d: (links[d], root[d]) for d in texts}


def leaks(texts, items, threshold=0.8):
    out = {}
    for d, t in texts.items():
        own = shingles(t)
        for i, item in items.items():
            want = shingles(item)
            if not own or not want:
                continue
            width, best = min(len(want), len(own)), 0
            for a in range(len(own) - width + 1):
                x, y = Counter(own[a : a + width]), Counter(want)
                best = max(best, sum((x & y).values()) / sum((x | y).values()))
            if best >= threshold:
                out[d, i] = best
    return out


def repeated(raws, length):
    count = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = [False] * len(r)
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((bytes(b for b, g in zip(r, gone) if not g), sum(gone), runs))
    return out


def cosine_links(vectors, least=0.9):
    def usable(v):
        return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    good = {k: v for k, v in vectors.items() if usable(v)}
    pairs = [(a, b) for a, b in combinations(sorted(good), 2) if len(good[a]) == len(good[b])
             and sum(x * y for x, y in zip(good[a], good[b])) / math.hypot(*good[a]) / math.hypot(*good[b]) >= least]
    links = Counter(x for p in pairs for x in p)
    root = roots(vectors, pairs)
    return {k: (links[k], root[k]) for k in vectors}


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def entropy(s):
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values())


def token_counts(texts):
    up, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return {d: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans(up, low))) + [None] for d, t in texts.items()}


def by(key, rows):
    out = defaultdict(list)
    for r in rows:
        out[r[key]].append(r)
    return out
