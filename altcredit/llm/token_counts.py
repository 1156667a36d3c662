"""Token counts by a two-tier lookup on the map side.

Texts are cut into segments between which no piece can reach, so a text has as many tokens as its
segments together. First tier: a compact table of the most frequent segments with their token
counts, sent to every task; its entries come from a count over all documents in which each task
reports its ``per_task`` most frequent segments, and ``frequent`` of those remain. Second tier:
what the table lacks is encoded by the library, once a task for each distinct segment, and kept in
the task's cache while that has room. No segment is shuffled but those reports; the table and the
cache only save work, the counts are the library's for any size of either.

Defined results: null and empty texts have no bytes and no tokens; special strings inside a text
are ordinary text; an empty table gives an empty result; other columns
are kept, and an input column with the name of a result is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from altcredit.llm import kernels as K
from altcredit.llm import pieces as P
from altcredit.llm.common import packed, schema, small_batches, unpacked, utf8_bytes

CACHE_ENTRIES = 400_000


def frequent_segments(docs: DataFrame, text: str, model, per_task: int, frequent: int) -> DataFrame:
    """The segments that occur most often in all documents."""

    def reports(batches):
        joint = P.Vocabulary(model.value).joint
        seen: dict[bytes, int] = {}
        for table in K.gathered(batches):
            found = P.segments(*P.marked(table["text"]), joint)[0].value_counts()
            order = np.argsort(-found.field("counts").to_numpy(), kind="stable")[: 2 * per_task]
            for row in found.take(pa.array(order)).to_pylist():
                seen[row["values"]] = seen.get(row["values"], 0) + row["counts"]
            if len(seen) > 8 * per_task:
                seen = dict(sorted(seen.items(), key=lambda x: -x[1])[: 4 * per_task])
        best = sorted(seen.items(), key=lambda x: -x[1])[:per_task]
        yield pa.RecordBatch.from_pydict({"segment": pa.array([s for s, _ in best], pa.binary()), "n": pa.array([n for _, n in best], pa.int64())})

    parts = docs.select(F.col(text).alias("text")).mapInArrow(reports, "segment binary, n bigint")
    return parts.groupBy("segment").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "segment").limit(frequent)


def encoded_lengths(library, found: list[bytes]) -> list[int]:
    return [len(x) for x in library.encode([s.decode() for s in found], num_threads=1)]


def token_counts(
    docs: DataFrame, model_path: str, text: str = "text", n_bytes: str = "n_bytes", n_tokens: str = "n_tokens",
    per_task: int = 4096, frequent: int = 16384,
) -> DataFrame:
    """The input with the texts' UTF-8 bytes and numbers of tokens."""
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(P.read_model(model_path))
    top = [bytes(r.segment) for r in frequent_segments(docs, text, model, per_task, frequent).collect()]
    table = spark.sparkContext.broadcast((top, encoded_lengths(P.Vocabulary(model.value).library, top)))

    def count(batches):
        words = P.Vocabulary(model.value)
        known, lengths = pa.array(table.value[0], pa.large_binary()), np.array([*table.value[1], 0], np.int64)
        cache: dict[bytes, int] = {}
        for rows in K.gathered(batches):
            found, first = P.segments(*P.marked(rows["text"]), words.joint)
            coded = found.dictionary_encode() if len(found) else None
            total = np.zeros(len(found) + 1, np.int64)
            if coded is not None:
                at = pc.index_in(coded.dictionary, value_set=known).fill_null(len(known)).to_numpy()
                size = lengths[at]
                missing = np.flatnonzero(at == len(known))
                size[missing] = _misses(coded.dictionary.take(pa.array(missing)).to_pylist(), cache, words.library)
                np.cumsum(size[coded.indices.to_numpy()], out=total[1:])
            yield from pa.table({"row": rows["row"], "n_tokens": pa.array(total[first[1:]] - total[first[:-1]])}).to_batches()

    rows = packed(docs, text=text)
    counted = rows.mapInArrow(count, schema(rows, ["row"], "n_tokens bigint"))
    return unpacked(counted, docs, **{n_bytes: utf8_bytes(f"row.`{text}`"), n_tokens: F.col("n_tokens")})


def _misses(wanted: list[bytes], cache: dict[bytes, int], library) -> list[int]:
    new = [s for s in wanted if s not in cache]
    lengths = dict(zip(new, encoded_lengths(library, new)))
    out = [lengths[s] if s in lengths else cache[s] for s in wanted]
    if len(cache) + len(new) > CACHE_ENTRIES:
        cache.clear()
    if len(new) <= CACHE_ENTRIES:
        cache.update(lengths)
    return out
