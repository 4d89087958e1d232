"""The same results the plain way, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, lower=False):
    text = text or ""
    return WORD.findall(text.translate(LOWER) if lower else text)


def components(nodes, links):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def near(rows, width, percent):
    """{id: (size, component)} of (id, text) rows, over all pairs that share a shingle."""
    sets, holders = {}, defaultdict(list)
    for i, text in rows:
        w = words(text, lower=True)
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()}
    common = defaultdict(int)
    for i in sorted(sets):
        for gram in sets[i]:
            for j in holders[gram]:
                common[j, i] += 1
            holders[gram].append(i)
    links = [(a, b) for (a, b), n in common.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    roots = components(sets, links)
    return {i: (len(sets[i]), roots[i]) for i in sets}


def copies(rows, cap=3, seed=20240229):
    """{id: copies} of (id, text, source) rows with unique ids, at weights 1, 2, 3 by turns."""
    size = defaultdict(int)
    for _, text, source in rows:
        size[source] += len(words(text))
    weight = {s: 1 + n % 3 for n, s in enumerate(sorted(size, key=lambda s: (s is None, s or "")))}
    open_, price = set(size), 0.0
    while open_:
        price = (sum(size.values()) - sum(cap * size[s] for s in size.keys() - open_)) / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * price > cap * size[s]}
        if not full:
            break
        open_ -= full
    out = {}
    for i, text, s in rows:
        rate = min(weight[s] * price, float(cap * size[s])) / size[s] if size[s] else 0.0
        draw = int(hashlib.md5(f"{seed}:{i}:{text or ''}".encode()).hexdigest()[:13], 16) / 16**13
        out[i] = int(rate) + (draw < rate - int(rate))
    return out


def repeats(rows, length):
    """{id: (words, removed, kept words)} when a window that also starts in a smaller id is removed."""
    first, texts = {}, {}
    for i, text in sorted(rows):
        texts[i] = words(text)
        for k in range(len(texts[i]) - length + 1):
            first.setdefault(tuple(texts[i][k : k + length]), i)
    out = {}
    for i, w in texts.items():
        gone = set()
        for k in range(len(w) - length + 1):
            if first[tuple(w[k : k + length])] < i:
                gone.update(range(k, k + length))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out
