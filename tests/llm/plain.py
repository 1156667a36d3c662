"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import collections
import hashlib
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = r"[^\x20\x09-\x0D]+"


def words(text):
    return re.findall(WORD, text or "")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


class Union:
    def __init__(self, n):
        self.parent = list(range(n))

    def find(self, x):
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, x, y):
        self.parent[self.find(x)] = self.find(y)


def shingles(text, n=5):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def jaccard_groups(texts, percent=75):
    """For each text the indexes of its component."""
    sets, union = [shingles(t) for t in texts], Union(len(texts))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                union.join(i, j)
    roots = [union.find(i) for i in range(len(texts))]
    members = collections.defaultdict(list)
    for i, r in enumerate(roots):
        members[r].append(i)
    return [members[r] for r in roots], [len(s) for s in sets]


def suffix_removed(rows, length=50):
    """(id, text) to (bytes, removed, spans, digest) as lists in the order of rows."""
    data = [(i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, b in data:
        for k in range(len(b) - length + 1):
            if i is not None:
                least[b[k : k + length]] = min(i, least.get(b[k : k + length], i))
    out = []
    for i, b in data:
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if i is not None and least[b[k : k + length]] < i:
                gone[k : k + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(b), sum(gone), spans, sha(bytes(c for c, g in zip(b, gone) if not g))))
    return out


def passages_removed(texts, window=35):
    """(words, removed, kept text) of each text."""
    every = [words(t) for t in texts]
    seen = collections.Counter(tuple(w[i : i + window]) for w in every for i in range(len(w) - window + 1))
    out = []
    for w in every:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def item_hits(texts, items, window=13):
    """(words, hit words, item ids) of each text."""
    grams = collections.defaultdict(set)
    for item, text in items:
        w = bench_words(text)
        size = min(window, len(w))
        for i in range(len(w) - size + 1) if size else ():
            grams[tuple(w[i : i + size])].add(str(item) if item is not None else "")
    sizes = {len(g) for g in grams}
    out = []
    for text in texts:
        w, hit, found = bench_words(text), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in grams:
                    hit.update(range(i, i + size))
                    found |= grams[tuple(w[i : i + size])]
        out.append((len(w), len(hit), sorted(found)))
    return out


def quality_stats(text):
    text = text or ""
    w = words(text)
    grams = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(inside), lines


def quality_kept(text):
    n, chars, symbols, dup, repeated, lines = quality_stats(text)
    capitals = sum("A" <= c <= "Z" for c in text or "")
    return not (
        n < 50 or 100 * repeated > 50 * n or 10 * symbols > n or (dup >= 4 and 10 * dup > 3 * len(lines))
        or chars < 2 * n or chars > 15 * n or 2 * capitals > chars
    )
