"""Linked sets within one block of sets, by a dual traversal of signature trees.

A leaf of the tree is a set's bitmap, with one bit a token, and its size; an inner node holds the
OR of its children's bitmaps and the range of their sizes. Two nodes are compared by the largest
overlap any of their sets could have: common bits, plus what collisions within a set may hide. A
pair of nodes whose largest overlap can't reach the threshold at their smallest sizes is dropped
with all pairs below it, and, where only components are wanted, so is a pair whose sets are in one
component already. What remains at the leaves is decided exactly on the tokens.
"""

from __future__ import annotations

import numpy as np

from altcredit.llm import kernels as K

BITS = 1024
FAN = 8
FRONT = 1 << 15


class Components:
    """Components of the sets of a block, kept as labels that all point to the smallest member."""

    def __init__(self, labels: np.ndarray):
        self.parent = np.unique(labels, return_index=True)[1][np.unique(labels, return_inverse=True)[1]].astype(np.int64)

    def find(self, x):
        root = self.parent[x]
        while True:
            above = self.parent[root]
            if (above == root).all():
                return root
            root = above

    def join(self, x: np.ndarray, y: np.ndarray) -> None:
        """Joins many pairs at once: hook the larger root to the smaller one until all agree."""
        while True:
            a, b = self.find(x), self.find(y)
            apart = a != b
            if not apart.any():
                return
            x, y = x[apart], y[apart]
            low, high = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
            np.minimum.at(self.parent, high, low)
            self.parent = self.find(np.arange(len(self.parent)))


class Block:
    """Sets as sorted tokens one after the other (``begin`` has one more entry), with full sizes.

    ``sizes`` may exceed the number of tokens given: tokens that no other set has are left out.
    """

    def __init__(self, tokens: np.ndarray, begin: np.ndarray, sizes: np.ndarray):
        self.begin, self.sizes, self.given = begin, sizes, np.diff(begin)
        known, rank = np.unique(tokens, return_inverse=True)
        self.rank, self.known = rank.astype(np.int64), len(known)
        owner = np.repeat(np.arange(len(sizes)), self.given)
        self.pairs = owner * self.known + self.rank
        bit = (known % np.uint64(BITS)).astype(np.int64)[self.rank]
        bits = np.zeros((len(sizes), BITS // 64), np.uint64)
        np.bitwise_or.at(bits, (owner, bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
        self.bits = bits

    def overlap(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Size of the intersection, for each pair."""
        out = np.zeros(len(x), np.int64)
        step = max(1, 2_000_000 // max(1, int(self.given.max(initial=1))))
        for i in range(0, len(x), step):
            a, b = x[i : i + step], y[i : i + step]
            at = K.ranges(self.begin[a], self.given[a])
            hit = K.member(self.pairs, np.repeat(b, self.given[a]) * self.known + self.rank[at])
            out[i : i + step] = np.add.reduceat(np.append(hit, 0), np.cumsum(self.given[a]) - self.given[a]) * (self.given[a] > 0)
        return out

    def linked(self, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
        """Whether 100 * intersection >= percent * union, for each pair."""
        return ((100 + percent) * self.overlap(x, y) >= percent * (self.sizes[x] + self.sizes[y])) & (x != y)


def link(block: Block, group: np.ndarray, labels: np.ndarray, percent: int) -> np.ndarray:
    """Components (index of the first member) after linking sets of equal ``group``.

    ``labels``: components known before. Sets come sorted by group, similar ones near each other.
    """
    parts = Components(labels)
    for gap in (1, 2):
        near = np.flatnonzero(group[gap:] == group[:-gap])
        near = near[parts.find(near) != parts.find(near + gap)]
        hit = block.linked(near, near + gap, percent)
        parts.join(near[hit], near[hit] + gap)
    edges = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    for low, high in zip(edges, np.append(edges[1:], len(group))):
        if high - low > 1:
            root = parts.find(np.arange(low, high))
            if (root != root[0]).any():
                for x, y in _traverse(block, int(low), int(high), percent, parts):
                    apart = parts.find(x) != parts.find(y)
                    hit = block.linked(x[apart], y[apart], percent)
                    if hit.any():
                        parts.join(x[apart][hit], y[apart][hit])
    return parts.find(np.arange(len(labels)))


def links(block: Block, group: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All linked pairs of equal ``group``, each once with the size of its intersection."""
    found = [(np.zeros(0, np.int64),) * 3]
    edges = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    for low, high in zip(edges, np.append(edges[1:], len(group))):
        if high - low > 1:
            for x, y in _traverse(block, int(low), int(high), percent):
                both = block.overlap(x, y)
                hit = (100 + percent) * both >= percent * (block.sizes[x] + block.sizes[y])
                found.append((x[hit], y[hit], both[hit]))
    return tuple(np.concatenate(a) for a in zip(*found))


def _levels(block: Block, low: int, high: int):
    """From the leaves up: OR of bitmaps, smallest and largest size, most tokens hidden by collisions."""
    bits, size = block.bits[low:high], block.sizes[low:high]
    hidden = block.given[low:high] - np.bitwise_count(bits).sum(axis=1)
    levels = [(bits, size, size, hidden)]
    while len(levels[-1][0]) > 1:
        bits, least, most, hidden = levels[-1]
        cut = np.arange(0, len(bits), FAN)
        levels.append((np.bitwise_or.reduceat(bits, cut), np.minimum.reduceat(least, cut), np.maximum.reduceat(most, cut), np.maximum.reduceat(hidden, cut)))
    return levels


def _one_component(root: np.ndarray, depth: int) -> list[np.ndarray]:
    """For each level the component of a node's sets, -1 if they have several."""
    out = [root]
    for _ in range(depth - 1):
        cut = np.arange(0, len(out[-1]), FAN)
        low, high = np.minimum.reduceat(out[-1], cut), np.maximum.reduceat(out[-1], cut)
        out.append(np.where(low == high, low, -1))
    return out


def _traverse(block: Block, low: int, high: int, percent: int, parts: Components | None = None):
    """Pairs of sets that may be linked, some at a time; with ``parts`` none within one component."""
    levels = _levels(block, low, high)
    members = np.arange(low, high)
    own = _one_component(parts.find(members), len(levels)) if parts else None
    top = np.zeros(1, np.int64)
    stack = [(len(levels) - 1, top, top)]
    while stack:
        level, a, b = stack.pop()
        if len(a) > FRONT:
            stack += [(level, a[i : i + FRONT], b[i : i + FRONT]) for i in range(0, len(a), FRONT)]
            continue
        bits, least, most, hidden = levels[level]
        if parts:
            apart = (own[level][a] != own[level][b]) | (own[level][a] < 0)
            a, b = a[apart], b[apart]
        overlap = np.bitwise_count(bits[a] & bits[b]).sum(axis=1) + np.maximum(hidden[a], hidden[b])
        overlap = np.minimum(overlap, np.minimum(most[a], most[b]))
        possible = (100 + percent) * overlap >= percent * (least[a] + least[b])
        a, b = a[possible], b[possible]
        if level:
            wide = len(levels[level - 1][0])
            i, j = (np.add.outer(np.arange(FAN), np.zeros(FAN, np.int64)).ravel(), np.tile(np.arange(FAN), FAN))
            a, b = (a[:, None] * FAN + i).ravel(), (b[:, None] * FAN + j).ravel()
            fits = (a < wide) & (b < wide) & (a <= b)
            stack.append((level - 1, a[fits], b[fits]))
            continue
        a, b = a[a < b] + low, b[a < b] + low
        for i in range(0, len(a), 512):
            yield a[i : i + 512], b[i : i + 512]
        if parts and len(a):
            own = _one_component(parts.find(members), len(levels))
