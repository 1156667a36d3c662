"""The best documents for each query by a term-weighted score, term at a time with limited accumulators.

One pass over the texts writes an index of segments: document ids, lengths, and for each term its
postings (document, occurrences). It also gives the collection's statistics: documents with terms, all
terms, documents that hold each term of a query. A second pass reads the segments only. In each segment
the terms of a query are taken rarest first; a posting adds to the accumulator of its document. As soon
as the largest sum that the remaining terms can add in this segment is below the k-th best partial
score (of the segment, or of what the task has found for the query so far), no document without an
accumulator can be among the k best, and no accumulator is opened any more; those that exist are
updated to the end, so their scores are exact. A bound equal to that score stops nothing, as ties go by
id. Each task gives k documents a query, which are merged by limited rankings.

The score is in integers: a term's weight is ``floor(1000 * ln((2N + 2) / (2df + 1)))``; a document
adds ``weight * ((10**9 * tf) div (1000 * tf + 8 * m))`` for each time the term is in the query, with
``m = 100 - 75 + (75 * n * N) div L``.

Queries are a stated set against all rows: they are taken in blocks of ``block_bytes``, each sent to
every task. The index holds the terms of the queries if those are at most ``max_terms``, else all.

Defined results: null and empty texts have no terms, are found by nothing and count in no statistic; a
query without terms, or whose terms nothing holds, has no rows; equal or null query ids are queries of
their own, each with its rows; ids of documents must be integers, a null id comes after all others;
repeated rows are found each on its own; empty tables give an empty result; other columns don't take part.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from altcredit.llm import kernels as K
from altcredit.llm.common import pieces_of, small_batches, total_bytes, written

#: What separates terms once A-Z are lower case: ASCII but digits and letters.
SEPARATORS = (*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80))
SEGMENT_BYTES = 8 << 20
SLOPE, LENGTH_PART = 8, 75


def _terms(column) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all terms, and the index of each text's first."""
    data, offsets = K.flat(column)
    data = K.lower_ascii(data)
    starts, ends, first = K.word_spans(data, offsets, K.byte_set(*SEPARATORS))
    return K.span_hashes(data, starts, ends), first


def build_index(docs: DataFrame, key: str, text: str, vocabulary: np.ndarray | None) -> DataFrame:
    """Segments: ids, lengths, terms, and the postings of each term by document."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def segments(batches):
        for table in K.gathered(batches, SEGMENT_BYTES):
            words, first = _terms(table["text"])
            n = table.num_rows
            owner = np.repeat(np.arange(n), np.diff(first))
            if known.value is not None:
                mine = K.member(known.value, words)
                words, owner = words[mine], owner[mine]
            terms, at = np.unique(words, return_inverse=True)
            pairs, tf = np.unique(at * n + owner, return_counts=True)
            begin = np.searchsorted(pairs, np.arange(len(terms) + 1) * n)
            fields = {"lengths": np.diff(first), "terms": terms, "begin": begin, "docs": (pairs % max(n, 1)).astype(np.int32), "tf": tf.astype(np.int32)}
            ids = table["id"].cast(pa.int64())
            row = {"ids": ids.fill_null(0).to_numpy().tobytes(), "none": ids.is_null().to_numpy().tobytes()} | {k: a.tobytes() for k, a in fields.items()}
            yield pa.RecordBatch.from_pydict({k: pa.array([v], pa.binary()) for k, v in row.items()})

    rows = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    names = ("ids", "none", "lengths", "terms", "begin", "docs", "tf")
    return written(rows.mapInArrow(segments, ", ".join(f"{n} binary" for n in names)), "postings")


def _numbers(row: dict) -> dict[str, np.ndarray]:
    kinds = {"ids": np.int64, "none": bool, "lengths": np.int64, "terms": np.uint64, "begin": np.int64, "docs": np.int32, "tf": np.int32}
    return {k: np.frombuffer(row[k], kinds[k]) for k in row}


def collection_size(index: DataFrame) -> tuple[int, int]:
    """Documents that have terms, and all terms with repeats."""

    def count(batches):
        sizes = [np.frombuffer(x, np.int64) for batch in batches for x in batch["lengths"].to_pylist()]
        yield pa.RecordBatch.from_pydict({"n": [int(sum((x > 0).sum() for x in sizes))], "terms": [int(sum(x.sum() for x in sizes))]})

    found = index.select("lengths").mapInArrow(count, "n bigint, terms bigint").agg(F.sum("n").alias("n"), F.sum("terms").alias("terms")).first()
    return found["n"] or 0, found["terms"] or 0


def document_counts(index: DataFrame) -> DataFrame:
    """Rows (term, df): in how many documents a term is."""

    def count(batches):
        terms, df = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                terms, at = np.unique(np.append(terms, np.frombuffer(row["terms"], np.uint64)), return_inverse=True)
                df = np.bincount(at, np.append(df, np.diff(np.frombuffer(row["begin"], np.int64))), len(terms)).astype(np.int64)
        yield from pa.table({"term": terms.view(np.int64), "df": df}).to_batches(50_000)

    parts = index.select("terms", "begin").mapInArrow(count, "term bigint, df bigint")
    return parts.groupBy("term").agg(F.sum("df").alias("df"))


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class Query:
    """Terms of a query, rarest first, each with its weight times its number in the query."""

    def __init__(self, words: np.ndarray, counts: dict[int, int], documents: int):
        terms, repeats = np.unique(words, return_counts=True)
        df = np.array([counts.get(t, 0) for t in terms.view(np.int64).tolist()], np.int64)
        order = [i for i in np.lexsort((terms, df)) if df[i]]
        self.terms = terms[order]
        self.weights = np.array([weight(documents, int(df[i])) * int(repeats[i]) for i in order], np.int64)


class Segment:
    """Postings with what each adds for a weight of one."""

    def __init__(self, row: dict, documents: int, all_terms: int):
        x = _numbers(row)
        self.ids, self.none, self.terms, self.begin, self.docs = x["ids"], x["none"], x["terms"], x["begin"], x["docs"]
        m = 100 - LENGTH_PART + (LENGTH_PART * x["lengths"] * documents) // max(all_terms, 1)
        tf = x["tf"].astype(np.int64)
        self.adds = (10**9 * tf) // (1000 * tf + SLOPE * m[self.docs])
        self.most = np.maximum.reduceat(self.adds, self.begin[:-1]) if len(self.terms) else np.zeros(0, np.int64)

    def best(self, query: Query, k: int, least: int, opened: list[int] | None = None) -> list[tuple[int, int, int]]:
        """The k best documents as (score, no id, id), among those that can reach ``least``."""
        at = np.searchsorted(self.terms, query.terms)
        at[at == len(self.terms)] = 0
        held = np.flatnonzero(self.terms[at] == query.terms) if len(self.terms) else np.zeros(0, np.int64)
        at, weights = at[held], query.weights[held]
        # What the terms from each on can add at most.
        rest = np.append(np.cumsum((weights * self.most[at])[::-1])[::-1], 0)
        total, alive, open_ = np.zeros(len(self.ids), np.int64), np.zeros(len(self.ids), bool), True
        for i, (term, w) in enumerate(zip(at.tolist(), weights.tolist())):
            low, high = self.begin[term], self.begin[term + 1]
            docs, adds = self.docs[low:high], self.adds[low:high]
            if open_ and rest[i] < max(least, _kth(total[alive], k)):
                open_ = False
            if open_:
                alive[docs] = True
            else:
                mine = alive[docs]
                docs, adds = docs[mine], adds[mine]
            total[docs] += w * adds
        if opened is not None:
            opened.append(int(alive.sum()))
        found = np.flatnonzero(alive & (total > 0))
        if len(found) > k:
            found = found[total[found] >= _kth(total[found], k)]
        order = np.lexsort((self.ids[found], self.none[found], -total[found]))[:k]
        return [(int(total[d]), bool(self.none[d]), int(self.ids[d])) for d in found[order]]


def _kth(scores: np.ndarray, k: int) -> int:
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


def _merged(found: list[tuple[int, int, int]], k: int) -> list[tuple[int, int, int]]:
    return heapq.nsmallest(k, found, key=lambda x: (-x[0], x[1], x[2]))


def _found(index: DataFrame, queries, k: int, documents: int, all_terms: int) -> DataFrame:
    """Rows (query, score, none, doc): the k best of each task for each query."""

    def search(batches):
        asked = queries.value
        best: list[list[tuple[int, int, int]]] = [[] for _ in asked]
        for batch in batches:
            for row in batch.to_pylist():
                segment = Segment(row, documents, all_terms)
                for q, query in enumerate(asked):
                    least = best[q][-1][0] if len(best[q]) == k else 0
                    found = segment.best(query, k, least)
                    best[q] = _merged(best[q] + found, k) if found else best[q]
        rows = [(q, *x) for q, found in enumerate(best) for x in found]
        columns = list(zip(*rows)) or [[], [], [], []]
        kinds = {"query": pa.int32(), "score": pa.int64(), "none": pa.bool_(), "doc": pa.int64()}
        yield pa.RecordBatch.from_pydict({n: pa.array(c, kind) for (n, kind), c in zip(kinds.items(), columns)})

    return index.mapInArrow(search, "query int, score bigint, none boolean, doc bigint")


def ranked_search(
    docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
    item_text: str = "text", max_terms: int = 4_000_000, block_bytes: int = 4 << 20,
) -> DataFrame:
    """Rows (item, rank, id, score): the k documents with the highest scores above 0 for each item."""
    spark = docs.sparkSession
    small_batches(spark)
    blocks = pieces_of(total_bytes(items, item_text), block_bytes)
    asked = items.select(F.col(f"`{item_key}`").alias("id"), F.col(f"`{item_text}`").alias("text"))
    block = lambda b: asked.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).toArrow()
    vocabulary: np.ndarray | None = np.zeros(0, np.uint64)
    for b in range(blocks):
        vocabulary = np.union1d(vocabulary, _terms(block(b)["text"])[0])
        if len(vocabulary) > max_terms:
            vocabulary = None
            break
    return search(build_index(docs, key, text, vocabulary), [block(b) for b in range(blocks)] if blocks == 1 else (block(b) for b in range(blocks)), k)


def search(index: DataFrame, blocks, k: int = 10) -> DataFrame:
    """The best documents of an index for blocks of queries, each an Arrow table (id, text)."""
    spark = index.sparkSession
    documents, all_terms = collection_size(index)
    counts = document_counts(index)
    out = None
    for table in blocks:
        words, first = _terms(table["text"])
        wanted = spark.createDataFrame(pa.table({"term": np.unique(words).view(np.int64)}))
        known = {r.term: r.df for r in counts.join(wanted, "term", "left_semi").toLocalIterator()}  # the terms of a block
        queries = [Query(words[i:j], known, documents) for i, j in zip(first[:-1], first[1:])]
        found = _found(index, spark.sparkContext.broadcast(queries), k, documents, all_terms)
        part = _top(found, table, k)
        out = part if out is None else out.unionByName(part)
    return out


def _top(found: DataFrame, table: pa.Table, k: int) -> DataFrame:
    """The k best of all tasks, with the ids of the queries."""
    order = [F.desc("score"), F.asc("none"), F.asc("doc")]
    # First among some of the tasks, so that the last ranking of a query gets few rows.
    for by in (["query", "part"], ["query"]):
        window = Window.partitionBy(*by).orderBy(*order)
        rows = found.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(256))) if "part" in by else found
        found = rows.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)
    number = table.append_column("query", pa.array(np.arange(table.num_rows), pa.int32())).select(["query", "id"])
    spark = found.sparkSession
    kind = StructType([StructField("query", StructType.fromDDL("query int")["query"].dataType)])
    names = spark.createDataFrame(number) if table.num_rows else spark.createDataFrame([], kind).withColumn("id", F.lit(None).cast("bigint"))
    doc = F.when(~F.col("none"), F.col("doc")).alias("id")
    return found.join(F.broadcast(names.withColumnRenamed("id", "item")), "query").select("item", F.col("rank").cast("int").alias("rank"), doc, "score")
