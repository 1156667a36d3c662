"""Suffix arrays of many short strings at once, by grouping (Baier, CPM 2016).

Phase 1 sorts suffixes into groups that share their longest Lyndon prefix. Groups start by first
byte and are processed in descending order: each member's previous-smaller pointer leads to the
nearest earlier suffix of a lower group; suffixes that are pointed to leave their group for new
ones right above it, one for each number of pointers. Phase 2 emits the order of every group from
the lowest suffix up, along the same pointers, so nothing is renamed or sorted again. Both phases
take linear time; here every step advances all strings together.
"""

from __future__ import annotations

import numpy as np

from altcredit.llm import kernels as K


def suffix_arrays(data: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Places in ``data``, string by string, in the order of the strings' suffixes.

    ``begin``: where each string begins, and the end of the last. Strings are not empty.
    """
    strings = len(begin) - 1
    sizes = np.diff(begin)
    # Each string gets an end mark below all bytes; one more mark stands before the first string.
    low = begin[:-1] + np.arange(1, strings + 1)
    n = int(begin[-1]) + strings + 1
    char = np.zeros(n, np.int16)
    char[K.ranges(low, sizes)] = data.astype(np.int16) + 1
    first = np.append(0, low)
    length = np.append(1, sizes + 1)

    owner = np.repeat(np.arange(strings + 1), length)
    order = np.argsort(owner * 512 + char, kind="stable")
    key = (owner * 512 + char)[order]
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    group = np.empty(n, np.int64)
    group[order] = np.repeat(new, np.diff(np.append(new, n)))
    size = np.zeros(n, np.int64)
    size[new] = np.diff(np.append(new, n))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    before = np.arange(-1, n - 1)
    mark = np.zeros(n, bool)
    _group_by_lyndon_prefix(char, first[1:], length[1:], order, group, size, place, before, mark)
    out = _emit(char, first[1:], length[1:], group, before)
    # Without the marks, in places of ``data``.
    keep = out[K.ranges(low + 1, sizes)]
    return keep - np.repeat(np.arange(1, strings + 1), sizes)


def _group_by_lyndon_prefix(char, first, length, order, group, size, place, before, mark) -> None:
    end = first + length
    while True:
        live = np.flatnonzero(end > first + 1)
        if not len(live):
            return
        start = group[order[end[live] - 1]]
        members = order[K.ranges(start, end[live] - start)]
        end[live] = start
        _point_back(members, group, before)
        pointed = before[members]
        pointed, pointers = np.unique(pointed[char[pointed] > 0], return_counts=True)
        if len(pointed):
            _split(pointed, pointers, order, group, size, place, mark)


def _point_back(members, group, before) -> None:
    """Previous suffix of a lower group; what lies between is in this group or a higher one."""
    while len(members):
        high = group[before[members]] >= group[members]
        members = members[high]
        before[members] = before[before[members]]


def _split(pointed, pointers, order, group, size, place, mark) -> None:
    """Moves suffixes to new groups above their old one, ordered by the number of pointers."""
    old = group[pointed]
    sort = np.lexsort((pointers, old))
    pointed, pointers, old = pointed[sort], pointers[sort], old[sort]
    head = np.append(True, old[1:] != old[:-1])
    heads = np.flatnonzero(head)
    moved = np.diff(np.append(heads, len(old)))
    top = (old + size[old])[heads] - moved
    target = np.arange(len(old)) + np.repeat(top - heads, moved)
    at = place[pointed]
    free = at[at < np.repeat(top, moved)]
    there = order[target]
    mark[pointed] = True
    stays = ~mark[there]
    mark[pointed] = False
    order[free], place[there[stays]] = there[stays], free
    order[target], place[pointed] = pointed, target
    new = np.flatnonzero(head | np.append(True, pointers[1:] != pointers[:-1]))
    count = np.diff(np.append(new, len(old)))
    size[old[heads]] -= moved
    size[target[new]] = count
    group[pointed] = np.repeat(target[new], count)


def _emit(char, first, length, group, before) -> np.ndarray:
    out = np.full(len(char), -1, np.int64)
    free = np.arange(len(char))
    done = np.zeros(len(char), bool)
    out[first], done[first + length - 1] = first + length - 1, True
    free[first] += 1
    sort = np.argsort(-length, kind="stable")
    first, length = first[sort], length[sort]
    for t in range(int(length[0])):
        first = first[: np.searchsorted(-length, -t)]
        suffix = out[first + t] - 1
        while True:
            suffix = suffix[(char[suffix] > 0) & ~done[suffix]]
            if not len(suffix):
                break
            slot = free[group[suffix]]
            out[slot], done[suffix] = suffix, True
            free[group[suffix]] = slot + 1
            suffix = before[suffix]
    return out
