"""Which fingerprints occur more than once in the whole collection.

Texts are dealt into groups of a few megabytes by a hash of id and text; rows that repeat both and are
more than a group's bytes are written once with the group of each, spread over several. A group packs its distinct fingerprints
by bucket and sends one row a bucket; a bucket merges what all groups sent, and answers each group
with those of its fingerprints that occur more than once. A fingerprint that every text contains
reaches its bucket once a group, so no bucket grows with the number of copies, and a group gets
back no more than it sent. All steps are groupings that Spark shuffles and can run again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from altcredit.llm import kernels as K
from altcredit.llm.common import pieces_of, utf8_bytes, written

GROUP_BYTES = 2 << 20
#: What a row counts for besides its text when repeated rows are measured.
ROW_BYTES = 64
SENT = "bucket int, g int, keys binary, many binary"
ANSWER = "g int, bucket int, keys binary"


def dealt(docs: DataFrame, key: str, text: str, group_bytes: int = GROUP_BYTES) -> tuple[DataFrame, int]:
    """Rows (g, id, text, row) and the number of groups; ``row`` holds the other columns."""
    h = F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`"))
    sizes = docs.groupBy(h.alias("h")).agg(F.count("*").alias("n"), F.sum(utf8_bytes(f"`{text}`") + ROW_BYTES).alias("size"))
    repeated = (F.col("n") > 1) & (F.col("size") > group_bytes)
    found = sizes.agg(F.sum(F.col("size") - F.col("n") * ROW_BYTES).alias("bytes"), F.sum(F.when(repeated, F.col("size"))).alias("repeated")).first()
    groups = max(pieces_of(found["bytes"] or 0, group_bytes), pieces_of(found["repeated"] or 0, group_bytes))
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in (key, text)]
    row = [F.struct(*rest).alias("row")] if rest else []
    rows = [F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"), *row]
    own = F.pmod(h, F.lit(groups)).cast("int")
    if not found["repeated"]:
        return docs.select(own.alias("g"), *rows), groups
    # No more rows than groups.
    heavy = F.broadcast(sizes.where(repeated).select("h", F.ceil(F.col("size") / group_bytes).alias("parts")))
    every = docs.select(h.alias("h"), own.alias("g"), *rows)
    names = [c for c in every.columns if c not in ("h", "g")]
    spread = F.pmod(F.col("g") + F.floor(F.rand(1) * F.col("parts")), F.lit(groups)).cast("int").alias("g")
    stored = written(every.join(heavy, "h").select(spread, *names), "repeated")
    return every.join(heavy, "h", "left_anti").select("g", *names).unionByName(stored), groups


def buckets_of(groups: int) -> int:
    return pieces_of(groups, 4, 8)


def pack(g: int, bucket: np.ndarray, **more: np.ndarray) -> pa.Table:
    """One row a bucket with its part of each array."""
    order = np.argsort(bucket, kind="stable")
    full, cuts = np.unique(bucket[order], return_index=True)
    cuts = [*cuts.tolist(), len(order)]
    parts = {n: [a[order[i:j]].tobytes() for i, j in zip(cuts, cuts[1:])] for n, a in more.items()}
    return pa.table(
        {"bucket": pa.array(full.astype(np.int32)), "g": pa.array(np.full(len(full), g, np.int32))}
        | {n: pa.array(v, pa.binary()) for n, v in parts.items()}
    )


def unpack(column, dtype=np.uint64) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype) for x in column.to_pylist()]


def codes(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and upper half of a fingerprint. Enough where a rare false recurrence only costs work."""
    return (keys % np.uint64(buckets)) << np.uint64(32) | keys >> np.uint64(32)


def send(g: int, buckets: int, keys: np.ndarray, narrow: bool = False) -> pa.Table:
    """``keys`` (``codes`` if narrow) of a group: distinct, with a mark on those that occur twice."""
    keys, counts = np.unique(keys, return_counts=True)
    if narrow:
        return _marked(pack(g, (keys >> np.uint64(32)).astype(np.int32), keys=keys.astype(np.uint32), many=counts > 1))
    return _marked(pack(g, (keys % np.uint64(buckets)).astype(np.int32), keys=keys, many=counts > 1))


def _marked(table: pa.Table) -> pa.Table:
    """Marks as bits."""
    marks = pa.array([np.packbits(a).tobytes() for a in unpack(table["many"], bool)], pa.binary())
    return table.set_column(table.column_names.index("many"), "many", marks)


def _answer(table: pa.Table, dtype, often: bool) -> pa.Table:
    sent = unpack(table["keys"], dtype)
    marks = [np.unpackbits(m, count=len(a)) for m, a in zip(unpack(table["many"], np.uint8), sent)]
    every, many = np.concatenate(sent), np.concatenate(marks).astype(bool)
    order = np.argsort(every)
    ordered = every[order]
    same = ordered[1:] == ordered[:-1]
    again = many[order]
    again[1:] |= same
    again[:-1] |= same
    found, number = np.unique(ordered[again], return_counts=True)
    keep = [(g, a[K.member(found, a)]) for g, a in zip(table["g"].to_pylist(), sent)]
    keep = [(g, a) for g, a in keep if len(a)]
    # The logarithm, in a byte; keys by it, so that the bytes take no room once compressed.
    level = [np.log2(number[np.searchsorted(found, a)]).astype(np.uint8) if often else np.zeros(0, np.uint8) for _, a in keep]
    if often:
        by = [np.argsort(x, kind="stable") for x in level]
        keep, level = [(g, a[o]) for (g, a), o in zip(keep, by)], [x[o] for x, o in zip(level, by)]
    keep = [(g, a.tobytes()) for g, a in keep]
    bucket = np.full(len(keep), table["bucket"][0].as_py(), np.int32)
    out = {"g": pa.array([g for g, _ in keep], pa.int32()), "bucket": pa.array(bucket), "keys": pa.array([a for _, a in keep], pa.binary())}
    return pa.table(out | ({"often": pa.array([x.tobytes() for x in level], pa.binary())} if often else {}))


def answers(sent: DataFrame, narrow: bool = False, often: bool = False) -> DataFrame:
    """For each group its fingerprints that occur more than once, anywhere; with ``often`` in how many groups."""
    dtype = np.uint32 if narrow else np.uint64
    out = ANSWER + (", often binary" if often else "")
    return sent.groupBy("bucket").applyInArrow(lambda table: _answer(table, dtype, often), out)


def received(table: pa.Table, narrow: bool = False) -> np.ndarray:
    """What came back to a group, sorted."""
    parts = unpack(table["keys"], np.uint32 if narrow else np.uint64)
    if not parts:
        return np.zeros(0, np.uint64)
    if narrow:
        parts = [a.astype(np.uint64) | np.uint64(b << 32) for a, b in zip(parts, table["bucket"].to_pylist())]
    return np.sort(np.concatenate(parts))


def received_often(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """What came back to a group (narrow), sorted, and the logarithm of the number of groups that have it."""
    parts = unpack(table["keys"], np.uint32)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint8)
    keys = np.concatenate([a.astype(np.uint64) | np.uint64(b << 32) for a, b in zip(parts, table["bucket"].to_pylist())])
    order = np.argsort(keys)
    return keys[order], np.concatenate(unpack(table["often"], np.uint8))[order]


def range_of(keys: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys with the smallest and the largest value of each."""
    if not len(keys):
        return keys, least, most
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[new], np.minimum.reduceat(least[order], new), np.maximum.reduceat(most[order], new)


def packed_range(g: int, buckets: int, keys: np.ndarray, least: np.ndarray, most: np.ndarray) -> pa.Table:
    """Rows as ``pack`` makes them; the largest values only where they differ, numbers as short as they can be."""
    keys, least, most = range_of(keys, least, most)
    table = pack(g, (keys % np.uint64(buckets)).astype(np.int32), keys=keys, least=least, most=most)
    kept_least, kept_most = [], []
    for low, high in zip(unpack(table["least"], least.dtype), unpack(table["most"], most.dtype)):
        kept_least.append(_short(low).tobytes())
        kept_most.append(np.packbits(high != low).tobytes() + _short(high[high != low]).tobytes())
    return table.set_column(3, "least", pa.array(kept_least, pa.binary())).set_column(4, "most", pa.array(kept_most, pa.binary()))


def _short(values: np.ndarray) -> np.ndarray:
    """As 32-bit numbers, if all fit."""
    fits = values.dtype == np.int64 and len(values) and values.min() >= -(2**31) and values.max() < 2**31
    return values.astype(np.int32) if fits else values


def _long(raw: bytes, n: int, dtype) -> np.ndarray:
    return np.frombuffer(raw, np.int32 if n and len(raw) == 4 * n else dtype).astype(dtype)


def unpacked_range(table: pa.Table, dtype=np.int64) -> tuple[list, list, list]:
    """Keys, smallest and largest values of each row of ``packed_range``."""
    keys, least, most = unpack(table["keys"]), [], []
    for k, low, high in zip(keys, table["least"].to_pylist(), table["most"].to_pylist()):
        least.append(_long(low, len(k), dtype))
        marks = -(-len(k) // 8)
        differ = np.unpackbits(np.frombuffer(high[:marks], np.uint8), count=len(k)).astype(bool)
        value = least[-1].copy()
        value[differ] = _long(high[marks:], int(differ.sum()), dtype)
        most.append(value)
    return keys, least, most


def lower_than(sent: list[np.ndarray], least: list[np.ndarray], most: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each sender the smallest value of all for those of its keys that it has with a larger one."""
    every = np.concatenate(least)
    known, smallest, _ = range_of(np.concatenate(sent), every, every)
    out = []
    for a, m in zip(sent, most):
        best = smallest[np.searchsorted(known, a)]
        out.append((a[best < m], best[best < m]))
    return out


def received_least(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys = unpack(table["keys"])
    values = [_long(v, len(k), np.int64) for k, v in zip(keys, table["least"].to_pylist())]
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return range_of(np.concatenate(keys), *[np.concatenate(values)] * 2)[:2]


def short_bytes(values: np.ndarray) -> bytes:
    return _short(values).tobytes()


def pairs_bytes(first: np.ndarray, second: np.ndarray) -> bytes:
    """Two columns of numbers that fit 32 bits, as places inside a group do."""
    return np.stack([first, second]).astype(np.int32).tobytes()


def pairs(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int32).astype(np.int64).reshape(2, -1)


def lookup(known: np.ndarray, values: np.ndarray, keys: np.ndarray, default: np.ndarray) -> np.ndarray:
    """The value known for each key, at most its default."""
    if not len(known) or not len(keys):
        return default
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, np.minimum(values[at], default), default)
