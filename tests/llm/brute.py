"""Plain versions of the operators, for small inputs."""

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def shingles(text, n):
    w = words((text or "").translate(LOWER))
    if len(w) < n:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def classes(rows, n, percent):
    """(id, set size, smallest id reachable) of every row with an id."""
    own = [(d, shingles(t, n)) for d, t in rows if d is not None]
    top = {d: d for d, _ in own}

    def find(d):
        while top[d] != d:
            d = top[d]
        return d

    for i, (a, x) in enumerate(own):
        for b, y in own[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                top[max(p, q)] = min(p, q)
    return [(d, len(s), find(d) if s else d) for d, s in own]


def without_repeats(rows, size):
    """(id, number of words, number removed, kept words) of every row."""
    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            if d is not None:
                first[k] = min(first.get(k, d), d)
    out = []
    for d, t in rows:
        w = words(t)
        gone = set()
        for i in range(len(w) - size + 1):
            if d is not None and first[tuple(w[i : i + size])] < d:
                gone.update(range(i, i + size))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def tiling(doc, item, least):
    """Greedy string tiling by trying everything; (number of marked tokens, lengths of the tiles)."""
    a, b = [False] * len(doc), [False] * len(item)
    tiles = []
    while True:
        best = (0, 0, 0)
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and not a[i + n] and not b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return sum(tiles), tiles
        a[i : i + n] = [True] * n
        b[j : j + n] = [True] * n
        tiles.append(n)


def counts(rows):
    return Counter(w for _, t in rows for w in words(t))
