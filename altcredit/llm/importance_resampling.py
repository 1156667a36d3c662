"""Importance resampling towards a target collection, by hashed n-grams of words.

A feature is a run of 1 to ``most`` consecutive words; its bucket is the CRC-32 of the words, joined by
one space, modulo the number of buckets. A bucket's gain is the smoothed log-ratio of its shares in the
target and in the documents; a document's weight is the floored mean of its features' gains. A draw
without replacement proportional to the weights adds seeded Gumbel noise to them and takes the highest sums.

Method: an Aho-Corasick automaton over words with a delimiter on either side. An entry carries the
word's CRC and length. One scan of a buffer of texts emits the payloads of its words in order; the CRC
of a run follows from the payloads of its words, each CRC being moved on by the length of what follows
(``composed``), so no run is ever built as a string. The automaton every task gets holds the ``frequent``
words that occur most often in both collections, as counted over all of them; words between two matches
are not in it and get their payloads directly. The dictionary's size changes the work only.

Counts of buckets are added up in each task before they are shuffled. The threshold of the draw comes
from the counts of the integer scores, which lie within about 115,000 values whatever the input; the
ranks are places in a table written in range-partitioned order, so no task gets all rows.

Defined results: null and empty texts have no features and weight 0 and are never drawn unless
``least_words`` is 0; a null id is drawn with the noise of an empty id and ties behind all ids; copies and
repeated rows are drawn each on its own; without target or documents all counts are 0, gains follow from
the smoothing; other columns, whatever their names, don't take part.
"""

from __future__ import annotations

import math
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from altcredit.llm import kernels as K
from altcredit.llm.common import pieces_of, schema, small_batches, written

#: What separates words once A-Z are lower case: ASCII but digits and letters.
SEPARATORS = (*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80))
SPACE = 0x20
#: The reflected polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320
BUCKETS = 10_000
#: Words longer than this stay out of the dictionary, so that its size is bounded.
LONGEST = 64
#: Bytes that one scan covers; the automaton's matches of a scan are in memory at once.
SCAN_BYTES = 2 << 20
#: Rows of the drawn that one task puts into order.
RANK_ROWS = 1_000_000


class Crc:
    """CRC-32 of concatenations, from the CRCs and lengths of the parts."""

    def __init__(self):
        one = np.zeros(32, np.uint64)
        for bit in range(32):
            # One zero bit more: a shift, and the polynomial where a bit falls out.
            one[bit] = POLYNOMIAL if bit == 0 else 1 << (bit - 1)
        for _ in range(3):
            one = self._times(one, one)
        self.byte = [one]  # by 2**k zero bytes

    @staticmethod
    def _times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
        out = np.zeros(len(vector), np.uint64)
        for bit in range(32):
            out ^= np.where((vector >> np.uint64(bit)) & np.uint64(1), matrix[bit], np.uint64(0))
        return out

    def moved(self, crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Each CRC behind which so many zero bytes stand."""
        out, k = crc.copy(), 0
        while (lengths >> k).any():
            if k == len(self.byte):
                self.byte.append(self._times(self.byte[-1], self.byte[-1]))
            now = np.flatnonzero((lengths >> k) & 1)
            out[now] = self._times(self.byte[k], out[now])
            k += 1
        return out

    def joined(self, left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
        """CRC of left and right, one after the other, ``length`` being that of the right."""
        return self.moved(left, length) ^ right


def composed(crc: np.ndarray, lengths: np.ndarray, owner: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each number of words up to ``most``: owner and CRC of all runs, one space between words."""
    out, runs, tool = [(owner, crc)], crc, Crc()
    space = np.full(len(crc), zlib.crc32(b" "), np.uint64)
    # A word behind a space is one part.
    part = tool.joined(space, crc, lengths) if most > 1 else crc
    for n in range(2, most + 1):
        if len(runs) < 2:
            break
        runs = tool.joined(runs[:-1], part[n - 1 :], lengths[n - 1 :] + 1)
        inside = owner[: len(runs)] == owner[n - 1 :]
        out.append((owner[: len(runs)][inside], runs[inside]))
    return out


class Scanner:
    """Payloads of the words of texts."""

    def __init__(self, words: list[bytes]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for at, word in enumerate(words):
            self.automaton.add_word(f" {word.decode('latin-1')} ", at)
        self.automaton.make_automaton()
        self.payload = np.array([[zlib.crc32(w), len(w)] for w in words] or np.zeros((0, 2)), np.int64).reshape(-1, 2)
        table = np.arange(256, dtype=np.uint8)
        table[65:91] += 32
        table[np.isin(table, SEPARATORS)] = SPACE
        self.table, self.blank = table, K.byte_set(SPACE)

    def prepared(self, column) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = K.flat(column)
        return self.table[data], offsets

    def payloads(self, column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """CRC, length and text of each word, in order."""
        data, offsets = self.prepared(column)
        starts, ends, first = K.word_spans(data, offsets, self.blank)
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        # A delimiter at every border of texts.
        data = np.insert(data, offsets, SPACE)
        starts, ends = starts + owner + 1, ends + owner + 1
        crc, lengths, low = np.zeros(len(starts), np.uint64), ends - starts, 0
        while low < len(starts):
            high = max(low + 1, int(np.searchsorted(ends, starts[low] + SCAN_BYTES, "right")))
            crc[low:high] = self._scanned(data[starts[low] - 1 : ends[high - 1] + 1], starts[low:high] - starts[low] + 1, lengths[low:high])
            low = high
        return crc, lengths, owner

    def _scanned(self, buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        out, known = np.zeros(len(starts), np.uint64), np.zeros(len(starts), bool)
        if len(self.payload):
            found = chain.from_iterable(self.automaton.iter(buffer.tobytes().decode("latin-1")))
            end, entry = np.fromiter(found, np.int64).reshape(-1, 2).T
            # A match ends at the delimiter behind its word.
            at = np.searchsorted(starts, end - self.payload[entry, 1])
            out[at], known[at] = self.payload[entry, 0].astype(np.uint64), True
        rest = np.flatnonzero(~known)
        if len(rest):
            size = lengths[rest]
            words = K.texts(buffer[K.ranges(starts[rest], size)], np.append(0, np.cumsum(size)), pa.large_binary()).dictionary_encode()
            crc = np.array([zlib.crc32(w) for w in words.dictionary.to_pylist()], np.uint64)
            out[rest] = crc[words.indices.to_numpy()]
        return out


def frequent_words(texts: DataFrame, frequent: int, per_task: int) -> list[bytes]:
    """The words of column ``text`` that occur most often; each task reports its ``per_task`` most frequent."""

    def reports(batches):
        scanner, seen = Scanner([]), {}
        for table in K.gathered(batches):
            data, offsets = scanner.prepared(table["text"])
            starts, ends, _ = K.word_spans(data, offsets, scanner.blank)
            starts, ends = starts[ends - starts <= LONGEST], ends[ends - starts <= LONGEST]
            size = ends - starts
            words = K.texts(data[K.ranges(starts, size)], np.append(0, np.cumsum(size)), pa.large_binary()).value_counts()
            best = np.argsort(-words.field("counts").to_numpy(), kind="stable")[: 2 * per_task]
            for row in words.take(pa.array(best)).to_pylist():
                seen[row["values"]] = seen.get(row["values"], 0) + row["counts"]
            if len(seen) > 8 * per_task:
                seen = dict(sorted(seen.items(), key=lambda x: -x[1])[: 4 * per_task])
        best = sorted(seen.items(), key=lambda x: -x[1])[:per_task]
        yield pa.RecordBatch.from_pydict({"word": pa.array([w for w, _ in best], pa.binary()), "n": pa.array([n for _, n in best], pa.int64())})

    parts = texts.select("text").mapInArrow(reports, "word binary, n bigint")
    top = parts.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(frequent)
    return [bytes(r.word) for r in top.collect()]


def bucket_counts(texts: DataFrame, words, most: int, buckets: int) -> np.ndarray:
    """How many features of column ``text`` fall into each bucket."""

    def count(batches):
        scanner, total = Scanner(words.value), np.zeros(buckets, np.int64)
        for table in K.gathered(batches):
            for _, crc in composed(*scanner.payloads(table["text"]), most):
                total += np.bincount((crc % np.uint64(buckets)).astype(np.int64), minlength=buckets)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(full), "n": pa.array(total[full])})

    parts = texts.select("text").mapInArrow(count, "bucket bigint, n bigint")
    out = np.zeros(buckets, np.int64)
    # One row a bucket.
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandths of the log-ratio of the smoothed shares."""
    size, wide, narrow = len(source), int(source.sum()) + len(source), int(target.sum()) + len(target)
    return np.array([math.floor(1000 * math.log((int(target[b]) + 1) * wide / ((int(source[b]) + 1) * narrow))) for b in range(size)], np.int64)


def weighted(rows: DataFrame, words, gain, most: int) -> DataFrame:
    """Rows (id, text_hash, n_words, n_features, weight) of rows (id, text_hash, text)."""

    def score(batches):
        scanner, value = Scanner(words.value), gain.value
        for table in K.gathered(batches):
            n = table.num_rows
            crc, lengths, owner = scanner.payloads(table["text"])
            features, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for mine, runs in composed(crc, lengths, owner, most):
                sums = np.zeros(len(runs) + 1, np.int64)
                np.cumsum(value[(runs % np.uint64(len(value))).astype(np.int64)], out=sums[1:])
                ends = np.searchsorted(mine, np.arange(n + 1))
                features += np.diff(ends)
                total += np.diff(sums[ends])
            mean = total // np.maximum(features, 1)
            out = {"n_words": np.bincount(owner, minlength=n), "n_features": features, "weight": mean}
            kept = {k: table[k] for k in ("id", "text_hash")}
            yield from pa.table(kept | {k: pa.array(v, pa.int64()) for k, v in out.items()}).to_batches()

    return rows.mapInArrow(score, schema(rows, ["id", "text_hash"], "n_words bigint, n_features bigint, weight bigint"))


def noise(key: Column, seed: int) -> Column:
    """Thousandths of a Gumbel variate that seed and key decide, rounded down."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(drawn, 1, 8), 16, 10).cast("bigint")
    return F.floor(F.lit(-1000) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("bigint")


def resampled(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", most: int = 1,
    buckets: int = BUCKETS, percent: int = 10, least_words: int = 20, seed: int = 2024, frequent: int = 8192, per_task: int = 4096,
) -> DataFrame:
    """Rows (id, text_hash, n_words, n_features, weight, score, rank), one for each document.

    ``rank`` is null where a document isn't drawn; ``text_hash`` is Spark's xxhash64 of the text.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("text_hash"), F.col(f"`{text}`").alias("text"))
    theirs = target.select(F.col(f"`{target_text}`").alias("text"))
    # At most `frequent` words of at most LONGEST bytes.
    words = spark.sparkContext.broadcast(frequent_words(rows.select("text").unionByName(theirs), frequent, per_task))
    gain = spark.sparkContext.broadcast(gains(bucket_counts(rows, words, most, buckets), bucket_counts(theirs, words, most, buckets)))
    found = weighted(rows, words, gain, most)
    score = (F.col("weight") + noise(F.col("id"), seed)).alias("score")
    # Narrow rows: no text is written or shuffled.
    scored = written(found.select("*", score, F.monotonically_increasing_id().alias("number")), "weights")
    return ranked(scored, F.col("n_words") >= least_words, percent)


def resampled_documents(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that are drawn, with all their columns; rows that repeat id and text go together."""
    drawn = resampled(docs, target, key, text, **options).where("rank is not null").select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, F.col(f"`{key}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("hash"))
    return rows.join(drawn, F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")), "left_semi").select("row.*")


def ranked(scored: DataFrame, eligible: Column, percent: int) -> DataFrame:
    """``rank`` among the highest ``percent`` of the eligible rows by score, then id, then number."""
    rows = scored.where(eligible).groupBy("score").count().collect()  # one row an integer score
    counts = sorted(((r["score"], r["count"]) for r in rows), reverse=True)
    wanted, lowest, seen = sum(n for _, n in counts) * percent // 100, None, 0
    for score, n in counts:
        if seen >= wanted:
            break
        lowest, seen = score, seen + n
    out = [c for c in scored.columns if c != "number"]
    if lowest is None:
        return scored.select(*out, F.lit(None).cast("bigint").alias("rank"))
    near = eligible & (F.col("score") >= lowest)
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("number")]
    parts = pieces_of(seen, RANK_ROWS)
    ordered = scored.where(near).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # The place of a row: its task and its place there.
    ordered = written(ordered.select("*", F.monotonically_increasing_id().alias("place")), "ranks")
    task, place = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    before, start = {}, 0
    for r in sorted(ordered.groupBy(task.alias("task")).count().collect()):  # one row a task
        before[r["task"]], start = start, start + r["count"]
    offsets = scored.sparkSession.createDataFrame(list(before.items()), "task bigint, before bigint")
    rank = F.col("before") + place + 1
    drawn = ordered.withColumn("task", task).join(F.broadcast(offsets), "task").select(*out, F.when(rank <= wanted, rank).alias("rank"))
    rest = scored.where(~F.coalesce(near, F.lit(False))).select(*out, F.lit(None).cast("bigint").alias("rank"))
    return drawn.unionByName(rest)
