"""Benchmark texts inside documents, by a distributed positional inverted index.

The index is a table of segments. A segment covers some documents and holds, for each term, the
sorted word positions at which it occurs (its postings). A benchmark window is looked up with its
rarest term first, as counted over all documents: the postings of that term, moved back by its
offset in the window, are the candidates, and the postings of the other terms, each moved by its
own offset, are intersected with them in order of rarity. Windows that begin with the same terms and offsets share
these steps (``Tree``), and candidates are taken a bounded number at a time, so texts of few different
words, as in a grid of digits, take time but no more memory than others. With ``slop`` a term may stand up to so
many words from its place (proximity); without, matches are exact phrases.

The index holds the terms of the benchmark only, if those are at most ``max_terms``; else all
terms. The benchmark is a stated query set: it is taken in blocks of ``block_bytes``, each sent to
every task and searched in all segments, and what the blocks find is merged by segment.

Defined results: null and empty texts have no words, no hits and no items; items without words
never occur; an item of fewer words than a window is one window; a null item id is written as the
empty string; repeated rows each give a row; empty tables give no hits or no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from altcredit.llm import kernels as K
from altcredit.llm.common import pieces_of, small_batches, total_bytes, written

#: What separates words once A-Z are lower case: ASCII but digits and letters.
SEPARATORS = (*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80))
#: Candidates that one step of a search takes at a time.
SLICE_ROWS = 1_000_000
MATCHES = "n_words bigint, n_hit bigint, items array<string>, spans array<struct<first:int,last:int>>"


def _words(column):
    data, offsets = K.flat(column)
    data = K.lower_ascii(data)
    starts, ends, first = K.word_spans(data, offsets, K.byte_set(*SEPARATORS))
    return K.span_hashes(data, starts, ends), first


def build_index(docs: DataFrame, key: str, text: str, vocabulary: np.ndarray | None) -> DataFrame:
    """Segments: document ids, the index of each document's first word, terms and their postings."""
    small_batches(docs.sparkSession)

    def segments(batches):
        task = pa.array([_task()])
        for n, table in enumerate(K.gathered(batches)):
            words, first = _words(table["text"])
            places = np.arange(len(words)) if vocabulary is None else np.flatnonzero(K.member(vocabulary, words))
            order = places[np.argsort(words[places], kind="stable")]
            terms, begin = np.unique(words[order], return_index=True)
            fields = (first, terms, np.append(begin, len(order)).astype(np.int32), order.astype(np.int32))
            row = {"segment": pa.array([f"{task[0]}-{n}"]), "ids": pa.array([table["id"].to_pylist()], pa.list_(table.schema.field("id").type))}
            row |= {name: pa.array([a.tobytes()], pa.binary()) for name, a in zip(("first", "terms", "begin", "places"), fields)}
            yield from pa.table(row).to_batches()

    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind = StructType.fromDDL("segment string, first binary, terms binary, begin binary, places binary")
    kind = StructType([kind["segment"], StructField("ids", ArrayType(rows.schema["id"].dataType)), *kind.fields[1:]])
    return written(rows.mapInArrow(segments, kind), "index")


def _task() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def term_counts(index: DataFrame) -> DataFrame:
    """Occurrences of each term over all documents."""

    def counts(batches):
        terms, numbers = [], []
        for batch in batches:
            terms += [np.frombuffer(x, np.uint64) for x in batch["terms"].to_pylist()]
            numbers += [np.diff(np.frombuffer(x, np.int32)) for x in batch["begin"].to_pylist()]
        if terms:
            every, at = np.unique(np.concatenate(terms), return_inverse=True)
            n = np.bincount(at, np.concatenate(numbers)).astype(np.int64)
            yield from pa.table({"term": every.view(np.int64), "n": n}).to_batches(10_000)

    part = index.select("terms", "begin").mapInArrow(counts, "term bigint, n bigint")
    return part.groupBy("term").agg(F.sum("n").alias("n"))


def windows_of(table: pa.Table, window: int) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
    """Distinct windows of benchmark items: terms (one row each, 0 beyond the end), lengths, items."""
    words, first = _words(table["text"])
    found: dict[bytes, set[str]] = {}
    for item, low, high in zip(table["id"].to_pylist(), first[:-1], first[1:]):
        size = min(window, high - low)
        for at in range(low, high - size + 1) if size else ():
            found.setdefault(words[at : at + size].tobytes(), set()).add(item or "")
    lengths = np.array([len(w) // 8 for w in found], np.int64)
    terms = np.zeros((len(found), window), np.uint64)
    for i, w in enumerate(found):
        terms[i, : lengths[i]] = np.frombuffer(w, np.uint64)
    return terms, lengths, [sorted(x) for x in found.values()]


def rarest_first(terms: np.ndarray, lengths: np.ndarray, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Terms and offsets of each window by rarity; a short window repeats its rarest term."""
    n = np.array([[counts.get(int(t), 0) for t in row] for row in terms.view(np.int64)], np.int64).reshape(terms.shape)
    n[np.arange(terms.shape[1]) >= lengths[:, None]] = np.iinfo(np.int64).max
    offsets = np.argsort(n, axis=1, kind="stable")
    offsets = np.where(np.arange(terms.shape[1]) < lengths[:, None], offsets, offsets[:, :1])
    return np.take_along_axis(terms, offsets, axis=1), offsets


class Tree:
    """The windows by their terms and offsets, rarest first; windows that begin alike share a path.

    So the postings of a term are intersected once for all windows that have it at the same offset behind the
    same rarer ones, and a block of windows costs what its different beginnings cost.
    """

    def __init__(self, terms: np.ndarray, offsets: np.ndarray, lengths: np.ndarray):
        n, width = terms.shape
        self.terms, code = np.unique(terms, return_inverse=True)
        # Steps of a window; -1 behind its end.
        steps = np.where(np.arange(width) < lengths[:, None], code.reshape(n, width) * width + offsets, -1)
        order = np.lexsort(steps.T[::-1])
        steps, self.width = steps[order], width
        self.lengths = lengths
        #: For each level and node: its step, the first and the number of its children, and the window that ends there.
        self.step, self.child, self.children, self.window = [], [], [], []
        same = np.zeros(n, bool)
        same[1:] = True
        parent = np.zeros(n, np.int64)
        for level in range(width):
            same[1:] &= steps[1:, level] == steps[:-1, level]
            here = steps[:, level] >= 0
            new = here & ~same
            node = np.cumsum(new) - 1
            at = np.flatnonzero(new)
            self.step.append(steps[at, level])
            if level:
                first = np.searchsorted(parent[at], np.arange(len(self.step[level - 1])))
                self.child.append(first)
                self.children.append(np.diff(np.append(first, len(at))))
            ends = here & (lengths[order] == level + 1)
            window = np.full(len(at), -1)
            window[node[ends]] = order[ends]
            self.window.append(window)
            parent = np.where(here, node, parent)
            # Rows that have ended are behind no node of the next level.
            parent[~here] = -1
        self.child.append(np.zeros(len(self.step[-1]), np.int64))
        self.children.append(np.zeros(len(self.step[-1]), np.int64))


class _Segment:
    """A segment's postings, as places of terms and as the term of each place."""

    def __init__(self, row: dict, tree: Tree):
        self.first, self.places = np.frombuffer(row["first"], np.int64), np.frombuffer(row["places"], np.int32)
        self.begin, known = np.frombuffer(row["begin"], np.int32), np.frombuffer(row["terms"], np.uint64)
        self.n = int(self.first[-1])
        # Terms of the windows as numbers of this segment; -1 where it lacks them.
        at = np.searchsorted(known, tree.terms)
        at[at == len(known)] = 0
        self.number = np.where(known[at] == tree.terms, at, -1) if len(known) else np.full(len(tree.terms), -1)
        self.term_at = np.full(self.n, -1, np.int32)
        self.term_at[self.places] = np.repeat(np.arange(len(known)), np.diff(self.begin))

    def holds(self, number: np.ndarray, place: np.ndarray, slop: int) -> np.ndarray:
        """Whether the terms stand at the places, or so many words from them."""
        if not slop:
            inside = place < self.n
            return inside & (self.term_at[np.where(inside, place, 0)] == number) & (number >= 0)
        postings = np.repeat(np.arange(len(self.begin) - 1), np.diff(self.begin)) * (self.n + 1) + self.places
        low = np.searchsorted(postings, number * (self.n + 1) + np.maximum(place - slop, 0))
        hit = postings[np.minimum(low, len(postings) - 1)]
        return (number >= 0) & (low < len(postings)) & (hit <= number * (self.n + 1) + place + slop) & (hit // (self.n + 1) == number)


def matches(segment: _Segment, tree: Tree, slop: int, slice_rows: int = SLICE_ROWS):
    """Window and first word of each match, in parts; no more than ``slice_rows`` candidates are taken at a time.

    A single term's postings may be more: they are no more than the segment's words.
    """
    if not segment.n or not len(tree.step[0]):
        return
    number, offset = segment.number[tree.step[0] // tree.width], tree.step[0] % tree.width
    sizes = np.where(number >= 0, segment.begin[number + 1] - segment.begin[number], 0).astype(np.int64)
    todo = []
    for nodes in _slices(sizes, slice_rows):
        start = segment.places[K.ranges(segment.begin[number[nodes]].astype(np.int64), sizes[nodes])].astype(np.int64)
        node = np.repeat(nodes, sizes[nodes])
        start = start - offset[node]
        todo = [(0, node[start >= 0], start[start >= 0])]
        while todo:
            level, node, start = todo.pop()
            window = tree.window[level][node]
            ended = window >= 0
            if ended.any():
                found, begin = window[ended], start[ended]
                document = np.searchsorted(segment.first, begin, "right") - 1
                whole = begin + tree.lengths[found] <= segment.first[document + 1]
                yield found[whole], begin[whole]
            more = tree.children[level][node]
            for rows in _slices(more, slice_rows):
                child = K.ranges(tree.child[level][node[rows]], more[rows])
                begin = np.repeat(start[rows], more[rows])
                step = tree.step[level + 1][child]
                place = begin + step % tree.width
                keep = segment.holds(segment.number[step // tree.width], place, slop)
                if keep.any():
                    todo.append((level + 1, child[keep], begin[keep]))


def _slices(sizes: np.ndarray, most: int):
    """Runs of indexes whose sizes add up to no more than ``most``, or that are single; empty ones left out."""
    index = np.flatnonzero(sizes)
    part = np.cumsum(sizes[index]) // most
    for run in np.split(index, np.flatnonzero(part[1:] != part[:-1]) + 1):
        if len(run):
            yield run


def find_items(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
    window: int = 13, slop: int = 0, max_terms: int = 4_000_000, block_bytes: int = 8 << 20,
) -> DataFrame:
    """Rows (id, n_words, n_hit, items, spans), one for each document.

    ``n_hit`` counts words inside any occurrence of a window, ``items`` are the ids (as text, sorted)
    of the items with occurring windows, ``spans`` the maximal runs of hit words.
    """
    vocabulary: np.ndarray | None = np.zeros(0, np.uint64)
    for table in _blocks(items, item_key, item_text, block_bytes):
        vocabulary = np.union1d(vocabulary, _words(table["text"])[0])
        if len(vocabulary) > max_terms:
            vocabulary = None
            break
    return search(build_index(docs, key, text, vocabulary), items, item_key, item_text, window, slop, block_bytes)


def _blocks(items: DataFrame, item_key: str, item_text: str, block_bytes: int):
    """The benchmark, a block at a time."""
    blocks = pieces_of(total_bytes(items, item_text), block_bytes)
    asked = items.select(F.col(item_key).cast("string").alias("id"), F.col(item_text).alias("text"))
    for b in range(blocks):
        yield asked.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).toArrow()


def search(
    index: DataFrame, items: DataFrame, item_key: str = "item_id", item_text: str = "text", window: int = 13, slop: int = 0,
    block_bytes: int = 8 << 20,
) -> DataFrame:
    """What ``find_items`` gives, from an index that may have been stored before; it must hold the items' terms.

    An index that ``build_index`` has made without a vocabulary holds all terms and serves any benchmark.
    """
    spark = index.sparkSession
    counts, found, blocks = term_counts(index), None, 0
    for table in _blocks(items, item_key, item_text, block_bytes):
        terms, lengths, names = windows_of(table, window)
        known = np.unique(terms).view(np.int64)
        part = counts.join(spark.createDataFrame(pa.table({"term": known})), "term", "left_semi")
        ordered, offsets = rarest_first(terms, lengths, {r.term: r.n for r in part.toLocalIterator()})
        sent = spark.sparkContext.broadcast((Tree(ordered, offsets, lengths), names))
        part = _matches(index, sent, slop)
        found, blocks = part if found is None else found.unionByName(part), blocks + 1
    return _merged(found) if blocks > 1 else found.drop("segment", "at")


def _matches(index: DataFrame, sent, slop: int) -> DataFrame:
    def search(batches):
        tree, names = sent.value
        for batch in batches:
            for row in batch.to_pylist():
                segment = _Segment(row, tree)
                first, change = segment.first, np.zeros(segment.n + 1, np.int64)
                pairs: list[np.ndarray] = []
                for window, start in matches(segment, tree, slop):
                    change += np.bincount(start, minlength=len(change)) - np.bincount(start + tree.lengths[window], minlength=len(change))
                    # Each document and window once.
                    pairs.append(np.unique((np.searchsorted(first, start, "right") - 1) * len(tree.lengths) + window))
                hit = np.concatenate([[0], np.cumsum(change[:-1]) > 0]).astype(np.int64)
                items: dict[int, set[str]] = {}
                for pair in np.unique(np.concatenate(pairs)).tolist() if pairs else ():
                    items.setdefault(pair // len(tree.lengths), set()).update(names[pair % len(tree.lengths)])
                spans = {d: _spans(hit[first[d] + 1 : first[d + 1] + 1]) for d in items}
                yield _rows(batch.schema.field("ids").type.value_type, row["segment"], row["ids"], first, items, spans)

    id_type = index.schema["ids"].dataType.elementType
    kind = StructType.fromDDL("segment string, at int, " + MATCHES)
    return index.mapInArrow(search, StructType([*kind.fields[:2], StructField("id", id_type), *kind.fields[2:]]))


def contaminated(n_words, n_hit):
    """At least a twentieth of the words are hit."""
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def _spans(hit: np.ndarray) -> list[dict]:
    edge = np.diff(np.concatenate([[0], hit, [0]]))
    return [{"first": a, "last": b - 1} for a, b in zip(np.flatnonzero(edge > 0).tolist(), np.flatnonzero(edge < 0).tolist())]


def _rows(id_type, segment, ids, first, items, spans) -> pa.RecordBatch:
    order = range(len(ids))
    return pa.RecordBatch.from_pydict(
        {
            "segment": pa.array([segment] * len(ids), pa.string()),
            "at": pa.array(order, pa.int32()),
            "id": pa.array(ids, id_type),
            "n_words": pa.array(np.diff(first)),
            "n_hit": pa.array([sum(s["last"] - s["first"] + 1 for s in spans.get(d, ())) for d in order], pa.int64()),
            "items": pa.array([sorted(items.get(d, ())) for d in order], pa.list_(pa.string())),
            "spans": pa.array([spans.get(d, []) for d in order], pa.list_(pa.struct({"first": pa.int32(), "last": pa.int32()}))),
        }
    )


def _merged(found: DataFrame) -> DataFrame:
    """What several blocks of the benchmark found in one document."""
    empty = F.array().cast("array<struct<first:int,last:int>>")

    def add(spans, x):
        touches = (F.size(spans) > 0) & (F.element_at(spans, -1)["last"] >= x["first"] - 1)
        last = F.struct(F.element_at(spans, -1)["first"].alias("first"), F.greatest(F.element_at(spans, -1)["last"], x["last"]).alias("last"))
        grown = F.concat(F.slice(spans, 1, F.greatest(F.size(spans) - 1, F.lit(0))), F.array(last))
        return F.when(touches, grown).otherwise(F.concat(spans, F.array(x)))

    by = found.groupBy("segment", "at").agg(
        F.first("id").alias("id"),
        F.first("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"),
    )
    by = by.withColumn("spans", F.aggregate("spans", empty, add))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, x: n + x["last"] - x["first"] + 1)
    return by.select("id", "n_words", n_hit.alias("n_hit"), "items", "spans")
