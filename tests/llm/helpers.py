"""Brute-force versions, by other means than the operators'."""

import re
from collections import defaultdict

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text, k=5):
    w = WORDS.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def near_copies(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    ids = sorted(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return sets, components(ids, links)


def repeats(texts, window=50):
    words, first = {}, {}
    for i in sorted(texts):
        words[i] = WORDS.findall(texts[i] or "")
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k : k + window]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


def one_edit(x, y):
    if abs(len(x) - len(y)) > 1:
        return False
    a = b = 0
    while a < min(len(x), len(y)) and x[a] == y[a]:
        a += 1
    while b < min(len(x), len(y)) - a and x[-1 - b] == y[-1 - b]:
        b += 1
    return a + b >= max(len(x), len(y)) - 1


def deduped_lines(texts, least=16):
    first, seen = {}, []
    for i in sorted(texts):
        for k, line in enumerate(texts[i].split("\n")):
            m = line.strip(" \t\r").lower()
            if len(m) >= least:
                seen.append((i, k, m))
                first.setdefault(m, (i, k))
    near = {x for x in first for y in first if first[y] < first[x] and one_edit(x, y)}
    gone = defaultdict(set)
    for i, k, m in seen:
        if (i, k) != first[m] or m in near:
            gone[i].add(k)
    return {i: ("\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]), len(gone[i])) for i, t in texts.items()}
