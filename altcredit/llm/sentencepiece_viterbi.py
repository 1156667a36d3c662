"""SentencePiece encoding and decoding, by a batched Viterbi search or by batched merges.

A text is cut into segments between which no piece can reach (``pieces``). The distinct segments of
a batch with equally many characters form a matrix and advance together, one character a step: the
hash of each substring that ends there comes from prefix sums and is probed in the sorted hashes of
the pieces, the best score of all starts is a vectorised maximum, and its start is the backpointer.
A character that no piece covers costs ten less than the lowest score and is written as its bytes.
Of equally good segmentations the one with the longer last piece wins, as in the library's search.

The search maximises the sum of the model's scores, which is what the library does for unigram
models. A model trained as BPE encodes by merges (``Merges``): all segments of a batch advance
together, in each round every segment merges its pair with the best score, the leftmost of equal
ones. ``encoded`` with ``as_model`` takes the one that the model's type asks for, so its ids are the
library's; without it the search is used for any model, whose ids are then a valid, lossless encoding
under the same pieces. ``decoded`` inverts either exactly, but for the mark character itself, which
the format can't tell from a space.

Defined results: null and empty texts have no ids and decode to empty texts; an empty table gives
an empty result; other columns are kept, and an input column with the name of a result is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from altcredit.llm import kernels as K
from altcredit.llm import pieces as P
from altcredit.llm.common import packed, schema, small_batches, unpacked

UNKNOWN_PENALTY = 10.0
#: Segments are searched this many bytes at a time.
SEARCH_BYTES = 1 << 18
#: Segments that need more rounds of merges are few and long; the library encodes those one by one.
ROUNDS = 64


class Search:
    """The pieces of a vocabulary by the hash of their bytes."""

    def __init__(self, vocabulary: P.Vocabulary):
        raw = [vocabulary.bytes[i] for i in vocabulary.normal]
        ends = np.cumsum([len(b) for b in raw])
        data = np.frombuffer(b"".join(raw), np.uint8)
        hashes = K.span_hashes(data, np.append(0, ends[:-1]), ends)
        order = np.argsort(hashes)
        self.keys, self.ids = hashes[order], vocabulary.normal[order].astype(np.int32)
        self.scores = vocabulary.scores[self.ids]
        self.unknown = float(vocabulary.scores[vocabulary.normal].min()) - UNKNOWN_PENALTY
        self.longest = max(len(b.decode()) for b in raw)
        self.byte_id = vocabulary.byte_id
        self.values, (self.up, self.down) = K.byte_values(), K.powers(2 * SEARCH_BYTES)

    def encode(self, segments: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all segments one after the other, and where each segment's ids begin."""
        data, offsets = K.flat(segments)
        ids, sizes, low = [], [], 0
        while low < len(segments):
            high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + SEARCH_BYTES, "right")) - 1)
            part, size = self._encode(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
            ids.append(part)
            sizes.append(size)
            low = high
        begin = np.append(0, np.cumsum(np.concatenate(sizes or [np.zeros(0, np.int64)])))
        return np.concatenate(ids or [np.zeros(0, np.int32)]), begin

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        up, down = (self.up, self.down) if len(data) < len(self.up) else K.powers(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * up[: len(data)], out=total[1:])
        chars = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        first = np.searchsorted(chars, offsets)
        lengths = np.diff(first)
        owner, step, found, start, end = [], [], [], [], []
        for n in np.unique(lengths[lengths > 0]):
            rows = np.flatnonzero(lengths == n)
            at = chars[first[rows][:, None] + np.arange(n + 1)]
            piece, back = self._search(at, total, down)
            live, place, k = np.arange(len(rows)), np.full(len(rows), n), 0
            while len(live):
                origin = place - back[live, place]
                owner.append(rows[live])
                step.append(np.full(len(live), -k))
                found.append(piece[live, place])
                start.append(at[live, origin])
                end.append(at[live, place])
                live, place, k = live[origin > 0], origin[origin > 0], k + 1
        if not owner:
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        owner, step, found, start, end = (np.concatenate(x) for x in (owner, step, found, start, end))
        order = np.lexsort((step, owner))
        return self._ids(data, len(offsets) - 1, owner[order], found[order], start[order], end[order])

    def _ids(self, data, segments: int, owner, found, start, end) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces in order, bytes for unknown characters, and how many each segment has."""
        size = np.where(found < 0, end - start, 1)
        ids = np.repeat(found, size)
        ids[ids < 0] = self.byte_id[data[K.ranges(start[found < 0], size[found < 0])]]
        return ids, np.bincount(owner, size, segments).astype(np.int64)

    def _search(self, at: np.ndarray, total: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Last piece and its characters for the best way to each place of each row; -1 for no piece."""
        rows, n = at.shape[0], at.shape[1] - 1
        best = np.zeros((rows, n + 1))
        piece = np.full((rows, n + 1), -1, np.int32)
        back = np.ones((rows, n + 1), np.int64)
        sums, inverse = total[at], down[at]
        for end in range(1, n + 1):
            reach = min(end, self.longest)
            starts = np.arange(end - reach, end)
            size = (at[:, end, None] - at[:, starts]).astype(np.uint64)
            keys = K.mix((sums[:, end, None] - sums[:, starts]) * inverse[:, starts] + size * K.LENGTH)
            place = np.minimum(np.searchsorted(self.keys, keys.ravel()), len(self.keys) - 1).reshape(keys.shape)
            known = self.keys[place] == keys
            score = np.where(known, self.scores[place], -np.inf)
            score[:, -1] = np.where(known[:, -1], score[:, -1], self.unknown)
            score += best[:, starts]
            choice = score.argmax(axis=1)
            row = np.arange(rows)
            best[:, end] = score[row, choice]
            piece[:, end] = np.where(known[row, choice], self.ids[place[row, choice]], -1)
            back[:, end] = reach - choice
        return piece, back


class Merges(Search):
    """Merges in the order of the scores, as a BPE model encodes."""

    def __init__(self, vocabulary: P.Vocabulary):
        super().__init__(vocabulary)
        self.library = vocabulary.library
        score = {vocabulary.bytes[i]: vocabulary.scores[i] for i in vocabulary.normal.tolist()}
        # No longer piece that begins or ends with it comes before it: all its places in a segment merge at once.
        last = {p for b, s in score.items() for k in range(1, len(b)) for p in (b[:k], b[k:]) if score.get(p, np.inf) <= s}
        _, of, equal = np.unique(self.scores, return_inverse=True, return_counts=True)
        self.at_once = (equal[of] == 1) & np.array([vocabulary.bytes[i] not in last for i in self.ids.tolist()])

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        up, down = (self.up, self.down) if len(data) < len(self.up) else K.powers(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * up[: len(data)], out=total[1:])
        chars = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        begin, finish = chars[:-1], chars[1:]
        first = np.searchsorted(chars, offsets)
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(first))

        def place(start: np.ndarray, end: np.ndarray) -> np.ndarray:
            """Place of the piece with these bytes, -1 for none."""
            keys = K.mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * K.LENGTH)
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            return np.where(self.keys[at] == keys, at, -1)

        def pairs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Piece and score of the symbols at these places with the ones after them."""
            after = np.minimum(at + 1, len(owner) - 1)
            piece = np.full(len(at), -1)
            inner = (owner[after] == owner[at]) & (after > at)
            piece[inner] = place(begin[at[inner]], finish[after[inner]])
            return piece, np.where(piece < 0, -np.inf, self.scores[piece])

        done, slow, rounds = [], np.zeros(0, np.int64), 0
        piece, score = pairs(np.arange(len(owner)))
        while len(owner):
            low = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = np.repeat(np.maximum.reduceat(score, low), np.diff(np.append(low, len(owner))))
            live = best > -np.inf
            done.append((owner[~live], begin[~live], finish[~live]))
            owner, begin, finish, piece, score, best = (x[live] for x in (owner, begin, finish, piece, score, best))
            if not len(owner) or rounds == ROUNDS:
                slow = np.unique(owner)
                break
            rounds += 1
            hit = np.flatnonzero(score == best)
            new = np.append(True, owner[hit[1:]] != owner[hit[:-1]])
            # Of overlapping pairs every second one merges, from the left.
            run = np.append(True, np.diff(hit) > 1)
            within = np.arange(len(hit)) - np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            hit = hit[np.where(self.at_once[piece[hit]], within % 2 == 0, new)]
            finish[hit] = finish[hit + 1]
            kept = np.ones(len(owner), bool)
            kept[hit + 1] = False
            moved = np.cumsum(kept) - 1
            owner, begin, finish, piece, score = (x[kept] for x in (owner, begin, finish, piece, score))
            changed = np.unique(np.append(moved[hit], np.maximum(moved[hit] - 1, 0)))
            piece[changed], score[changed] = pairs(changed)
        owner, begin, finish = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in ([d[i] for d in done] for i in range(3)))
        order = np.argsort(begin)
        owner, begin, finish = owner[order], begin[order], finish[order]
        at = place(begin, finish)
        found = np.where(at < 0, -1, self.ids[at]).astype(np.int32)
        ids, size = self._ids(data, len(offsets) - 1, owner, found, begin, finish)
        if len(slow):
            texts = [data[offsets[i] : offsets[i + 1]].tobytes().decode() for i in slow.tolist()]
            more = [np.array(x, np.int32) for x in self.library.encode(texts)]
            cuts = np.cumsum(size) - size
            ids = np.insert(ids, np.repeat(cuts[slow], [len(x) for x in more]), np.concatenate(more))
            size[slow] = [len(x) for x in more]
        return ids, size


def encoded(docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids", as_model: bool = False) -> DataFrame:
    """The input with the ids of each text; with ``as_model`` by merges if the model is BPE."""
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(P.read_model(model_path))

    def encode(batches):
        vocabulary = P.Vocabulary(model.value)
        search = Merges(vocabulary) if as_model and vocabulary.bpe else Search(vocabulary)
        for rows in K.gathered(batches, 2 << 20):
            segments, first = P.segments(*P.marked(rows["text"]), vocabulary.joint)
            if len(segments):
                coded = segments.dictionary_encode()
                of, begin = search.encode(coded.dictionary)
                at = coded.indices.to_numpy()
                size = np.diff(begin)[at]
                flat = of[K.ranges(begin[at], size)]
                offsets = np.append(0, np.cumsum(size))[first]
            else:
                flat, offsets = np.zeros(0, np.int32), np.zeros(len(rows) + 1, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            yield from pa.table({"row": rows["row"], "ids": lists}).to_batches()

    rows = packed(docs, text=text)
    return unpacked(rows.mapInArrow(encode, schema(rows, ["row"], "ids array<int>")), docs, **{ids: F.col("ids")})


def decoded(frame: DataFrame, model_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """The input with the text of its ids; a null list gives an empty text."""
    spark = frame.sparkSession
    model = spark.sparkContext.broadcast(P.read_model(model_path))

    def decode(batches):
        raw = P.Vocabulary(model.value).bytes
        size = np.array([len(b) for b in raw], np.int64)
        start = np.cumsum(size) - size
        data = np.frombuffer(b"".join(raw), np.uint8)
        for rows in K.gathered(batches, 2 << 20):
            lists = rows["ids"].combine_chunks().fill_null(pa.scalar([], pa.list_(pa.int32())))
            flat = lists.flatten().to_numpy()
            first = np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
            out = data[K.ranges(start[flat], size[flat])]
            offsets = np.append(0, np.cumsum(size[flat]))[first]
            keep = np.ones(len(out), bool)
            lead = offsets[:-1][offsets[1:] > offsets[:-1]]
            keep[lead] = out[lead] != 32
            moved = np.append(0, np.cumsum(keep))
            yield from pa.table({"row": rows["row"], "text": K.texts(out[keep], moved[offsets]).cast(pa.string())}).to_batches()

    rows = packed(frame, ids=ids)
    return unpacked(rows.mapInArrow(decode, schema(rows, ["row"], "text string")), frame, **{text: F.col("text")})
