"""Array code for the Python workers: words, hashes of substrings, windows.

A batch of texts is one byte buffer with offsets; all functions work on the whole buffer at once.
Hashes have 64 bits and depend on content only: a polynomial modulo 2**64 over random byte values,
taken from prefix sums, then mixed with the length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
#: Odd, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
LENGTH = U(0xA0761D6478BD642F)
STEP = 1 << 16
WHITE = (9, 10, 11, 12, 13, 32)


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def texts(data: np.ndarray, offsets: np.ndarray, kind=None) -> pa.Array:
    """The inverse of ``flat``, as large strings or ``kind``."""
    offsets = np.ascontiguousarray(offsets, np.int64)
    parts = [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.Array.from_buffers(kind or pa.large_utf8(), len(offsets) - 1, parts)


def byte_set(*members: int) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


def lower_ascii(data: np.ndarray) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below n."""

    def chain(base: int) -> np.ndarray:
        x = np.full(max(n, 1), base, U)
        x[0] = 1
        return np.multiply.accumulate(x)

    return chain(BASE), chain(pow(BASE, -1, 1 << 64))


def byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray):
    """Starts and ends of words in the buffer, and the index of each text's first word.

    No word crosses the border of two texts.
    """
    inside = ~separators[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = offsets[1:] > offsets[:-1]
    first[offsets[:-1][full]] = inside[offsets[:-1][full]]
    last[offsets[1:][full] - 1] = inside[offsets[1:][full] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span; spans are ordered by start and may overlap."""
    out, values, i = np.empty(len(starts), U), byte_values(), 0
    up, down = powers(STEP)
    while i < len(starts):
        low = starts[i]
        j = int(np.searchsorted(starts, low + STEP))
        width = ends[i:j].max() - low
        if width > len(up):
            up, down = powers(int(width))
        total = np.zeros(width + 1, U)
        np.cumsum(values[data[low : low + width]] * up[:width], out=total[1:])
        out[i:j] = (total[ends[i:j] - low] - total[starts[i:j] - low]) * down[starts[i:j] - low]
        i = j
    return mix(out + (ends - starts).astype(U) * LENGTH)


def span_hashes_at(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` bytes from each start on, in any order of the starts."""
    sort = np.argsort(starts, kind="stable")
    out = np.empty(len(starts), U)
    out[sort] = span_hashes(data, starts[sort], starts[sort] + length)
    return out


def window_hashes(items: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k items; over byte values the same as ``span_hashes`` of k bytes."""
    n = len(items)
    if n < k:
        return np.zeros(0, U)
    out = np.empty(n - k + 1, U)
    up, down = powers(min(STEP, n) + k)
    for low in range(0, n - k + 1, STEP):
        part = items[low : low + STEP + k - 1]
        total = np.zeros(len(part) + 1, U)
        np.cumsum(part * up[: len(part)], out=total[1:])
        m = len(part) - k + 1
        out[low : low + m] = (total[k:] - total[:m]) * down[:m]
    return mix(out + np.array([k], U) * LENGTH)


def sliding_argmin(values: np.ndarray, w: int) -> np.ndarray:
    """Index of the smallest of each w consecutive values, the leftmost of equal ones."""
    best, at, have = values, np.arange(len(values)), 1
    while have < w:
        step = min(have, w - have)
        left, right = best[:-step], best[step:]
        better = right < left
        best = np.where(better, right, left)
        at = np.where(better, at[step:], at[:-step])
        have += step
    return at


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ..., each start with its length, one after the other."""
    lengths = np.maximum(lengths, 0)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


def member(ordered: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which of x occur in a sorted array."""
    if not len(ordered) or not len(x):
        return np.zeros(len(x), bool)
    at = np.searchsorted(ordered, x)
    at[at == len(ordered)] = 0
    return ordered[at] == x


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n places lie in a run of ``length`` that begins at one of the (distinct) starts."""
    change = np.zeros(n + length + 1, np.int32)
    change[starts] += 1
    change[starts + length] -= 1
    return np.cumsum(change[:n]) > 0


def joined_words(data, offsets, starts, ends, first_word, keep):
    """Kept words of each text, one space between them, as bytes and offsets."""
    kept = np.flatnonzero(keep)
    owner = np.searchsorted(first_word, kept, "right") - 1
    change = np.zeros(len(data) + 1, np.int8)
    change[starts[kept]] += 1
    change[ends[kept]] -= 1
    mask = np.cumsum(change[:-1], dtype=np.int8).astype(bool)
    followed = ends[kept[:-1][owner[1:] == owner[:-1]]]
    out = data.copy()
    out[followed] = 32
    mask[followed] = True
    sizes = np.zeros(len(data) + 1, np.int64)
    np.cumsum(mask, out=sizes[1:])
    return out[mask], sizes[offsets]


def gathered(batches, size: int = 4 << 20):
    """Tables of about ``size`` bytes of text from a stream of record batches."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.nbytes
        if n >= size:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _leftmost_minimum(values: np.ndarray, span: int, at: np.ndarray) -> np.ndarray:
    """Place of the smallest of the ``span`` values from each place in ``at`` on, the leftmost of equal ones.

    The place modulo 128 rides in the low bits, so one minimum finds value and place. It orders places
    rightly in all windows but those that hold a multiple of 128; these take a second one, half a turn
    apart.
    """
    seven, index = U(127), np.arange(len(values), dtype=U)
    out = np.empty(len(at), np.int64)
    wraps = (at & 127) + span > 128
    for turn, mine in ((0, ~wraps), (64, wraps)):
        best = (values & ~seven) | ((index + U(turn)) & seven)
        have = 1
        while have < span:
            move = min(have, span - have)
            best = np.minimum(best[:-move], best[move:])
            have += move
        start = at[mine]
        out[mine] = start + (((best[start] & seven).astype(np.int64) - start - turn) & 127)
    return out


def smallest_seeds(data: np.ndarray, offsets: np.ndarray, length: int, seed: int, step: int = 1 << 17):
    """Runs of windows of ``length`` bytes that select the same seed of ``seed`` bytes.

    A window selects its seed with the smallest hash, the leftmost of equal ones, so equal windows
    select equal seeds at equal places. Gives the first window of each run, the number of its
    windows, the place and the hash of the seed; windows lie inside one text. Takes ``step`` windows
    at a time, whatever the length of a text.
    """
    inside = np.ones(len(data), bool)
    tail = np.minimum(np.diff(offsets), length - 1)
    inside[ranges(offsets[1:] - tail, tail)] = False
    values, span = byte_values(), length - seed + 1
    assert span <= 64
    out: list[tuple] = []
    for low in range(0, len(data), step):
        part = data[low : low + step + length - 1]
        at = np.flatnonzero(inside[low : low + step])
        if not len(at):
            continue
        grams = window_hashes(values[part], seed)
        chosen = _leftmost_minimum(grams, span, at)
        new = np.flatnonzero(np.append(True, (chosen[1:] != chosen[:-1]) | (at[1:] != at[:-1] + 1)))
        out.append((at[new] + low, np.diff(np.append(new, len(at))), chosen[new] + low, grams[chosen[new]]))
    if not out:
        return (*(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, U))
    return tuple(np.concatenate(x) for x in zip(*out))
