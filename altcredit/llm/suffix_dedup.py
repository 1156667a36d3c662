"""Removal of byte strings that an earlier document holds, with suffix arrays over what recurs.

A byte goes if a string of ``length`` bytes covers it that also starts in a document with a smaller
id. The texts stay in groups of a few megabytes; groups exchange fingerprints by bucket
(``recurring``), never texts or pairs of documents:

1. Every window of ``length`` bytes selects a seed (winnowing). Seeds that occur in several documents
   recur; windows of other seeds occur in one document only.
2. Consecutive windows with the same seed form a region. For each region around a recurring seed its
   group learns the smallest document that holds the same region, and for each seed whether it has
   several different regions. A region that a smaller document holds goes as a whole. A seed with one
   region has no other occurrence of any of its windows.
3. What remains are the first occurrences of regions whose seed has others too. Their suffix arrays are
   built by grouping (``suffix_order``), over strings of regions of one seed; neighbours whose first ``length``
   bytes agree form a class with its smallest document. Each class sends the fingerprint of one of
   its members, by which the classes of other strings and groups join it. A
   group also sends itself the places it has decided and those still open, so that the last pass
   finds no seeds again; the rows of a group are put in one order first.

Strings are judged on the input. Ids must be integers. Defined results: a null id neither removes
nor loses anything; equal ids don't remove from each other; null and empty texts have no bytes; an
empty table gives an empty result; other columns are kept whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from altcredit.llm import kernels as K
from altcredit.llm import recurring as R
from altcredit.llm import suffix_order
from altcredit.llm.common import small_batches, written

#: Larger groups than usual, as the steps of a group's suffix arrays are shared by all its strings.
GROUP_BYTES = 4 << 20
NO_ID = np.iinfo(np.int64).max
#: Bytes of one string, and of the strings whose suffix arrays are built together.
STRING_BYTES = 1 << 10
BATCH_BYTES = 1 << 20
SENT = "bucket int, g int, kind int, keys binary, least binary, most binary"
ANSWER = "g int, kind int, keys binary, least binary"
REGION, SEED, WINDOW, PLACES = range(4)


def _ordered(table: pa.Table) -> pa.Table:
    """A group's rows by id, equal ids by text, whatever order they arrive in.

    The passes that exchange regions or places must see a group's bytes in the same order.
    """
    ids = _ids(table)
    order = np.argsort(ids, kind="stable")
    if (ids[order][1:] == ids[order][:-1]).any():
        data, offsets = K.flat(table["text"])
        order = np.lexsort((K.span_hashes(data, offsets[:-1], offsets[1:]), ids))
    return table.take(pa.array(order))


def _ids(table: pa.Table) -> np.ndarray:
    return table["id"].combine_chunks().cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


class _Group:
    """A group's texts, the runs of windows with one seed, and who owns them."""

    def __init__(self, table: pa.Table, length: int, seed: int):
        self.length = length
        self.data, self.offsets = K.flat(table["text"])
        self.start, self.count, _, self.seed = K.smallest_seeds(self.data, self.offsets, length, seed)
        self.id = _ids(table)[np.searchsorted(self.offsets, self.start, "right") - 1]
        known = self.id != NO_ID
        self.start, self.count, self.seed, self.id = (a[known] for a in (self.start, self.count, self.seed, self.id))

    def regions(self, which=slice(None)) -> np.ndarray:
        start = self.start[which]
        return K.span_hashes(self.data, start, start + self.count[which] + self.length - 1)

    def first_of(self, answer: pa.Table):
        """Region hashes, the smallest document of each, and whether its seed has other regions."""
        kind = answer["kind"].to_numpy()
        hashes = self.regions()
        least = R.lookup(*R.received_least(answer.filter(pa.array(kind == REGION))), hashes, self.id)
        several = np.sort(np.concatenate([np.zeros(0, np.uint64), *R.unpack(answer.filter(pa.array(kind == SEED))["keys"])]))
        return hashes, least, K.member(several, self.seed)


def _seeds(g: int, buckets: int, texts: _Group) -> pa.Table:
    """Seeds by half fingerprints, marked if several documents of the group have them."""
    codes = R.codes(texts.seed, buckets)
    order = np.lexsort((texts.id, codes))
    codes, ids = codes[order], texts.id[order]
    new = np.append(True, (codes[1:] != codes[:-1]) | (ids[1:] != ids[:-1]))[: len(codes)]
    return R.send(g, buckets, codes[new], narrow=True)


def _regions(g: int, buckets: int, texts: _Group, recurring: np.ndarray) -> pa.Table:
    own = K.member(recurring, R.codes(texts.seed, buckets))
    hashes = texts.regions(own)
    sent = (R.packed_range(g, buckets, hashes, texts.id[own], texts.id[own]), R.packed_range(g, buckets, texts.seed[own], hashes, hashes))
    kinds = [t.append_column("kind", pa.array(np.full(len(t), k, np.int32))) for t, k in zip(sent, (REGION, SEED))]
    return pa.concat_tables(kinds).select(["bucket", "g", "kind", "keys", "least", "most"])


def _resolve(table: pa.Table) -> pa.Table:
    """A bucket's answers: smaller documents of regions and windows, seeds that have several regions."""
    kind = table["kind"].to_numpy()
    out: list[tuple] = []
    for k in (REGION, WINDOW):
        rows = table.filter(pa.array(kind == k))
        if len(rows):
            found = R.lower_than(*R.unpacked_range(rows))
            out += [(g, k, a.tobytes(), R.short_bytes(v)) for g, (a, v) in zip(rows["g"].to_pylist(), found) if len(a)]
    seeds = table.filter(pa.array(kind == SEED))
    if len(seeds):
        keys, low, high = R.unpacked_range(seeds, np.uint64)
        known, low, high = R.range_of(*(np.concatenate(x) for x in (keys, low, high)))
        several = known[low != high]
        answers = [(g, a[K.member(several, a)]) for g, a in zip(seeds["g"].to_pylist(), keys)]
        out += [(g, SEED, a.tobytes(), b"") for g, a in answers if len(a)]
    out += [(r["g"], PLACES, r["keys"], r["least"]) for r in table.filter(pa.array(kind == PLACES)).to_pylist()]
    g, kinds, keys, least = zip(*out) if out else ((), (), (), ())
    return pa.table({"g": pa.array(g, pa.int32()), "kind": pa.array(kinds, pa.int32()), "keys": pa.array(keys, pa.binary()), "least": pa.array(least, pa.binary())})


def _agree(data: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Whether each suffix but the first has its first ``length`` bytes in common with the one before it."""
    padded = np.append(data, np.zeros(8, np.uint8))
    # Eight bytes from every place on, as a number.
    word = np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))
    same = np.arange(max(len(order) - 1, 0))
    for at in [*range(0, length - 7, 8), length - 8]:
        same = same[word[order[same] + at] == word[order[same + 1] + at]]
    out = np.zeros(max(len(order) - 1, 0), bool)
    out[same] = True
    return out


def _classes(texts: _Group, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window hashes in the regions with the smallest and largest document, from suffix arrays."""
    which = which[np.argsort(texts.seed[which], kind="stable")]
    sizes = texts.count[which] + texts.length - 1
    keys, least, most = [], [], []
    for part in np.split(which, np.searchsorted(np.cumsum(sizes), np.arange(BATCH_BYTES, sizes.sum(), BATCH_BYTES))):
        if not len(part):
            continue
        start, size, seed = texts.start[part], texts.count[part] + texts.length - 1, texts.seed[part]
        data = texts.data[K.ranges(start, size)]
        at = np.cumsum(size) - size
        new_seed = np.append(True, seed[1:] != seed[:-1])
        piece = (at - np.repeat(at[new_seed], np.diff(np.append(np.flatnonzero(new_seed), len(part))))) // STRING_BYTES
        begin = np.append(at[new_seed | np.append(True, piece[1:] != piece[:-1])], len(data))
        order = suffix_order.suffix_arrays(data, begin)
        offset = np.arange(len(data)) - np.repeat(at, size)
        whole = offset < np.repeat(texts.count[part], size)
        order = order[whole[order]]
        owner = np.repeat(texts.id[part], size)[order]
        string = np.searchsorted(begin, order, "right")
        # Neighbours in the order of the suffixes that have the first bytes in common.
        first = np.flatnonzero(np.append(True, ~_agree(data, order, texts.length) | (string[1:] != string[:-1])))
        keys.append(K.span_hashes_at(data, order[first], texts.length))
        least.append(np.minimum.reduceat(owner, first))
        most.append(np.maximum.reduceat(owner, first))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(least), np.concatenate(most)


def suffix_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 50, seed: int = 24) -> DataFrame:
    """Rows (id, kept, n_bytes, n_removed, n_spans[, row]): ``kept`` is the remaining bytes."""
    small_batches(docs.sparkSession)
    rows, groups = R.dealt(docs, key, text, GROUP_BYTES)
    buckets = R.buckets_of(groups)

    def seeds(key, table):
        return _seeds(key[0].as_py(), buckets, _Group(table, length, seed))

    def regions(key, table, found):
        return _regions(key[0].as_py(), buckets, _Group(_ordered(table), length, seed), R.received(found, narrow=True))

    def windows(key, table, found):
        g = key[0].as_py()
        texts = _Group(_ordered(table), length, seed)
        hashes, least, several = texts.first_of(found)
        gone = least < texts.id
        own = np.flatnonzero(several & ~gone)
        places = [R.pairs_bytes(texts.start[x], texts.count[x]) for x in (gone, own)]
        rest = pa.table({"bucket": pa.array([buckets + g], pa.int32()), "g": pa.array([g], pa.int32()), "kind": pa.array([PLACES], pa.int32())}
                        | {c: pa.array([v], pa.binary()) for c, v in zip(("keys", "least"), places)}
                        | {"most": pa.array([b""], pa.binary())})
        own = own[np.sort(np.unique(hashes[own], return_index=True)[1])]
        sent = R.packed_range(g, buckets, *_classes(texts, own))
        sent = sent.append_column("kind", pa.array(np.full(len(sent), WINDOW, np.int32)))
        return pa.concat_tables([sent.select(rest.column_names), rest])

    def cut(key, table, found):
        table = _ordered(table)
        data, o = K.flat(table["text"])
        ids = _ids(table)
        kind = found["kind"].to_numpy()
        places = found.filter(pa.array(kind == PLACES)).to_pylist()[0]
        whole, at = (K.ranges(*R.pairs(places[c])) for c in ("keys", "least"))
        owner = ids[np.searchsorted(o, at, "right") - 1]
        lower = R.received_least(found.filter(pa.array(kind == WINDOW)))
        part = at[R.lookup(*lower, K.span_hashes(data, at, at + length), owner) < owner]
        removed = K.covered(np.concatenate([whole, part]), length, len(data))
        total = np.append(0, np.cumsum(removed))
        begins = removed.copy()
        begins[1:] &= ~removed[:-1]
        border = o[:-1][o[:-1] < len(removed)]
        begins[border] = removed[border]
        spans = np.append(0, np.cumsum(begins))
        out = {
            "id": table["id"],
            "kept": K.texts(data[~removed], o - total[o], pa.large_binary()).cast(pa.binary()),
            "n_bytes": pa.array(np.diff(o)),
            "n_removed": pa.array(np.diff(total[o])),
            "n_spans": pa.array(np.diff(spans[o])),
        }
        return pa.table(out | ({"row": table["row"]} if "row" in table.column_names else {}))

    longs = [StructField(c, LongType()) for c in ("n_bytes", "n_removed", "n_spans")]
    rest = [f for f in rows.schema.fields if f.name == "row"]
    schema = StructType([StructField("id", rows.schema["id"].dataType), StructField("kept", BinaryType()), *longs, *rest])
    by = rows.groupBy("g")
    recurring = R.answers(by.applyInArrow(seeds, R.SENT), narrow=True)
    asked = by.cogroup(recurring.groupBy("g")).applyInArrow(regions, SENT)
    # What the first two passes shuffled goes before the texts are shuffled for the last two.
    resolved = written(asked.groupBy("bucket").applyInArrow(_resolve, ANSWER), "regions")
    sent = by.cogroup(resolved.groupBy("g")).applyInArrow(windows, SENT)
    final = sent.groupBy("bucket").applyInArrow(_resolve, ANSWER)
    return by.cogroup(final.groupBy("g")).applyInArrow(cut, schema)
