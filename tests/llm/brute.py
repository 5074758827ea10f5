"""Plain versions to hold the operators against."""

import hashlib
from collections import Counter, defaultdict
from math import floor

import regex


def grams(words, n):
    return list(zip(*[words[i:] for i in range(n)], strict=False))


def jaccard(a, b):
    m = sum((a & b).values())
    total = sum(a.values()) + sum(b.values()) - m
    return m / total if total else 1.0


def shingles(text, size=5):
    w = (text or "").encode().split()
    return Counter(grams(w, size)) if len(w) >= size else Counter([tuple(w)] if w else [])


def roots(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_classes(texts, least=0.8):
    """Class of each row by its place."""
    sets = [shingles(t) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if jaccard(sets[i], sets[j]) >= least]
    return roots(pairs, range(len(sets)))


def word_dedup(rows, size):
    """rows: (id, text); a row without an id stands after all others."""
    rank = lambda i: float("inf") if i is None else i
    first = {}
    for i, t in rows:
        for g in grams((t or "").encode().split(), size):
            first[g] = min(first.get(g, float("inf")), rank(i))
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k, g in enumerate(grams(w, size)):
            if first[g] < rank(i):
                gone[k : k + size] = [True] * size
        kept = b" ".join(x for x, y in zip(w, gone, strict=True) if not y)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def byte_dedup(rows, need):
    texts = [(t or "").encode() for _, t in rows]
    count = Counter(t[k : k + need] for t in texts for k in range(len(t) - need + 1))
    out = []
    for (i, _), t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for k in range(len(t) - need + 1):
            if count[t[k : k + need]] > 1:
                gone[k : k + need] = b"\1" * need
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def kept_bytes(rows, need):
    """What byte_dedup() keeps of each row, in the order of rows."""
    texts = [(t or "").encode() for _, t in rows]
    count = Counter(t[k : k + need] for t in texts for k in range(len(t) - need + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - need + 1):
            if count[t[k : k + need]] > 1:
                gone[k : k + need] = b"\1" * need
        out.append(bytes(c for c, g in zip(t, gone, strict=True) if not g))
    return out


def mixed(rows, temper, seed=17):
    """id -> (topic, tokens, rate, copies) for rows of (id, text, lang, source)."""
    n = lambda p, t: len(regex.findall(p, t))
    tokens = {i: n(r"\p{L}{1,6}|\p{N}{1,3}|[^\s\p{L}\p{N}]{1,3}", t) for i, t, _, _ in rows}
    form = [{i: len(t) / (t.count(" ") + 1) for i, t, _, _ in rows if t}, {i: n(r"[^\s\p{L}]", t) / len(t) for i, t, _, _ in rows if t}]
    cuts = [[sorted(f.values())[max(0, -(-len(f) * k // 3) - 1)] for k in (1, 2)] for f in form]
    place = lambda k, i: "".join(str(int(form[k][i] > c)) for c in cuts[k])
    topic = {i: f"long{place(0, i)} marked{place(1, i)}" if all(i in f for f in form) else None for i in tokens}
    cell = {i: {"source": s, "lang": x, "topic": topic[i]} for i, _, x, s in rows}
    goal, weight = {}, {}
    for d, power in temper.items():
        by = defaultdict(int)
        for i, c in cell.items():
            by[c[d]] += tokens[i]
        goal[d] = {v: x**power / sum(y**power for y in by.values()) for v, x in by.items()}
        weight[d] = dict.fromkeys(by, 1.0)
    total = sum(tokens.values())
    for done in range(1, 61):
        off = 0
        for d in temper:
            mass = defaultdict(float)
            for i, c in cell.items():
                others = [weight[o][c[o]] for o in temper if o != d]
                mass[c[d]] += tokens[i] * others[0] * others[1]
            new = {v: share * total / mass[v] if mass[v] else 1.0 for v, share in goal[d].items()}
            off = max(off, *(abs(new[v] / weight[d][v] - 1) for v in new))
            weight[d] = new
        if done % 6 == 0 and off <= 1e-6:
            break
    out = {}
    for i, c in cell.items():
        rate = round(weight["source"][c["source"]] * weight["lang"][c["lang"]] * weight["topic"][c["topic"]], 6)
        chance = int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:13], 16) / (1 << 52)
        out[i] = topic[i], tokens[i], rate, floor(rate) + (chance < rate - floor(rate))
    return out


def plain(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is not None, str(type(x)), x) if not isinstance(x, bool) else (True, "", x) for x in r))
