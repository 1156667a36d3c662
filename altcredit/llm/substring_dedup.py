"""Repeated passages by seed and extend.

Seeds: each window of ``window`` words selects one of its ``seed``-word runs, the one with the
smallest hash (winnowing); equal windows select equal seeds. Joining the documents on these
anchors leaves the anchors that occur more than once. Extension: around such an anchor, to both
sides, lie all windows that selected it; those whose whole word sequence occurs more than once are
kept, and runs of them are the maximal repeats of at least ``window`` words. Both joins compare
distinct fingerprints of groups of documents (``recurring``), so a passage that a third of the
documents hold is one fingerprint a group, never a pair of documents.

Defined results: null and empty texts have no words and lose none; texts shorter than a window lose
none; copies of a long text lose all their words, whether their ids are equal or not; an empty
table gives an empty result; other columns are kept whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from altcredit.llm import kernels as K
from altcredit.llm import recurring as R
from altcredit.llm.common import small_batches


def _windows(table: pa.Table, window: int, seed: int):
    """Words of the group's texts, their windows' hashes and anchors."""
    data, offsets = K.flat(table["text"])
    starts, ends, first = K.word_spans(data, offsets, K.byte_set(*K.WHITE))
    words = K.span_hashes(data, starts, ends)
    valid = K.ranges(first[:-1], np.diff(first) - window + 1)
    runs = K.window_hashes(words, seed)
    at = K.sliding_argmin(runs, window - seed + 1)[valid] if len(valid) else valid
    return (data, offsets, starts, ends, first), words, valid, runs, at


def substring_dedup(
    docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 35, seed: int = 8, whole: bool = False
) -> DataFrame:
    """Rows (id, kept, n_words, n_removed[, row]): ``kept`` is the kept words, one space between.

    With ``whole`` a text that loses nothing is kept as it is, white space included.
    """
    small_batches(docs.sparkSession)
    rows, groups = R.dealt(docs, key, text)
    buckets = R.buckets_of(groups)

    def seeds(key, table):
        _, _, _, runs, at = _windows(table, window, seed)
        return R.send(key[0].as_py(), buckets, R.codes(runs[np.unique(at)], buckets), narrow=True)

    def extensions(key, table, found):
        _, words, valid, runs, at = _windows(table, window, seed)
        anchors = R.received(found, narrow=True)
        near = valid[K.member(anchors, R.codes(runs[at], buckets))] if len(valid) else valid
        return R.send(key[0].as_py(), buckets, K.window_hashes(words, window)[near] if len(near) else words[:0])

    def cut(key, table, found):
        spans, words, valid, _, _ = _windows(table, window, seed)
        data, offsets, starts, ends, first = spans
        repeated = R.received(found)
        hashes = K.window_hashes(words, window)
        gone = K.covered(valid[K.member(repeated, hashes[valid])], window, len(words)) if len(valid) else np.zeros(len(words), bool)
        kept, bounds = K.joined_words(data, offsets, starts, ends, first, ~gone)
        lost = np.concatenate([[0], np.cumsum(gone)])[first]
        kept = K.texts(kept, bounds).cast(pa.string())
        if whole:
            kept = pc.if_else(pa.array(np.diff(lost) > 0), kept, table["text"].combine_chunks().cast(pa.string()))
        out = {"id": table["id"], "kept": kept, "n_words": pa.array(np.diff(first)), "n_removed": pa.array(np.diff(lost))}
        return pa.table(out | ({"row": table["row"]} if "row" in table.column_names else {}))

    schema = StructType([StructField("id", rows.schema["id"].dataType), StructField("kept", StringType()), StructField("n_words", LongType()), StructField("n_removed", LongType())])
    schema = StructType(schema.fields + [f for f in rows.schema.fields if f.name == "row"])
    by = rows.groupBy("g")
    anchors = R.answers(by.applyInArrow(seeds, R.SENT), narrow=True)
    repeats = R.answers(by.cogroup(anchors.groupBy("g")).applyInArrow(extensions, R.SENT))
    return by.cogroup(repeats.groupBy("g")).applyInArrow(cut, schema)
