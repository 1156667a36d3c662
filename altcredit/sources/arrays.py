"""JSON array files read by many tasks.

An array can't be cut at line ends: a bracket may stand in a string, a string may hold line breaks. So a
file is read as text that ends at every ``}``, which Spark splits by bytes as it does lines, and in two passes:

1. each split reports, for both cases that it begins outside or inside a string, whether it ends in the other
   one (parity of its unescaped quotes), how the bracket depth changes and how deep it falls. A split is
   one small row. Taken in file order these rows tell in which state each split really begins;
2. each split cuts itself into records with that. A record belongs to the split in which it begins. One that
   goes on in the next split is handed on in pieces, which are put together afterwards: there is at most
   one such record at each border of splits, and none where records hold no brace but their own.

What a fragment does is found by built-in text functions; the running sums over the fragments of a split are
Arrow batches of small numbers.

A record is an object in the top-level array, or a top-level object. A file whose brackets or quotes don't come
out even, or that begins with neither, is one damaged record. In the others, an object that is no JSON, and
anything but one comma between objects, is a damaged record in its place.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Executors need numpy and pyarrow, but no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

END = "}"
DAMAGED = "}"
PLACE = ("source_path", "source_file", "block_start")
_PLACE = "source_path string, source_file string, block_start bigint"
PIECE = f"{_PLACE}, ordinal bigint, value string, base int"
SUMMARY = f"{_PLACE}, flips boolean, head string, " + ", ".join(f"{n}_{case} bigint" for case in ("out", "in") for n in ("least", "tail", "depth"))
_ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}


def _batch(ddl: str, rows: list[dict]) -> pa.RecordBatch:
    fields = [x.split(" ") for x in ddl.split(", ")]
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema([(n, _ARROW[k]) for n, k in fields]))


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    """Text up to each closing brace, its place, and what it does.

    ``flips``: it holds an odd number of quotes. ``outside``, ``inside``: the change of the depth by its
    brackets, if it begins outside or inside a string. Its closing brace is not part of it.
    """
    text = spark.read.option("lineSep", END).option("encoding", "UTF-8").text(path)
    # Only quotes and the brackets between them count.
    marks = F.split(F.regexp_replace("value", r'(?s)\\.|[^"\[\]{]', ""), '"', -1)
    placed = text.select(
        F.col("_metadata.file_path").alias("source_path"),
        F.col("_metadata.file_name").alias("source_file"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("ordinal"),
        "value",
        marks.alias("marks"),
    )

    def change(odd: int):
        brackets = F.array_join(F.filter("marks", lambda x, i: i % 2 == odd), "")
        return (F.char_length(F.replace(brackets, F.lit("]"), F.lit(""))) * 2 - F.char_length(brackets)).cast("long")

    flips = F.size("marks") % 2 == 0
    return placed.select(*PLACE, "ordinal", "value", flips.alias("flips"), change(0).alias("outside"), change(1).alias("inside"))


def _stretches(batch: pa.RecordBatch):
    """The parts of a batch that lie in one split: where they begin and end, and the split."""
    coded = batch.column("source_path").dictionary_encode().indices.to_numpy()
    starts = batch.column("block_start").to_numpy()
    cuts = np.flatnonzero((coded[1:] != coded[:-1]) | (starts[1:] != starts[:-1])) + 1
    edges = [0, *cuts.tolist(), len(starts)]
    for i, j in zip(edges, edges[1:]):
        if j > i:
            yield i, j, {n: batch.column(n)[i].as_py() for n in PLACE}


class _State:
    """A reader's state between fragments: inside a string or not, and the depth."""

    def __init__(self, inside: bool, depth: int):
        self.inside, self.depth = inside, depth

    def over(self, batch: pa.RecordBatch, i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Goes over fragments i to j. Depth before and after each one's closing brace, and whether that brace counts."""
        part = batch.slice(i, j - i)
        flips = part.column("flips").to_numpy(zero_copy_only=False).astype(np.int64)
        inside = (np.cumsum(flips) + self.inside) % 2
        change = np.where(inside ^ flips, part.column("inside").to_numpy(), part.column("outside").to_numpy())
        closes = inside == 0
        after = self.depth + np.cumsum(change - closes)
        self.inside, self.depth = bool(inside[-1]), int(after[-1])
        return after + closes, after, closes


def _summaries(batches):
    """One row a split: what it does to a reader that comes to it outside or inside a string, at depth 0."""
    place, row, states = None, {}, {}
    for batch in batches:
        for i, j, here in _stretches(batch):
            if here != place:
                if place is not None:
                    yield _batch(SUMMARY, [row])
                place, states = here, {"out": _State(False, 0), "in": _State(True, 0)}
                row = {**here, "head": batch.column("value")[i].as_py().removeprefix("﻿").lstrip()[:1]}
            for case, state in states.items():
                before, after, _ = state.over(batch, i, j)
                # The lowest depth between fragments, the last one of the split left out.
                least = [row.get(f"least_{case}"), row.get(f"depth_{case}"), *([int(after[:-1].min())] if j - i > 1 else [])]
                row[f"least_{case}"] = min((x for x in least if x is not None), default=None)
                row[f"tail_{case}"], row[f"depth_{case}"] = int(before[-1]), int(after[-1])
            row["flips"] = states["out"].inside
    if place is not None:
        yield _batch(SUMMARY, [row])


@dataclass(frozen=True)
class Start:
    """How a split begins, the depth at which records lie in its file, and whether it is the file's last."""

    inside: bool
    depth: int
    base: int
    last: bool

    @property
    def in_record(self) -> bool:
        return self.inside or self.depth > self.base


def starts_of(rows: list) -> tuple[dict[tuple, Start], list[tuple[str, str]]]:
    """The state in which each split of the whole files begins, by path and place; and the damaged files."""
    starts: dict[tuple, Start] = {}
    damaged: list[tuple[str, str]] = []
    by_file: dict[tuple, list] = {}
    for r in sorted(rows, key=lambda r: r["block_start"]):
        by_file.setdefault((r["source_path"], r["source_file"]), []).append(r)
    for file, splits in by_file.items():
        base = {"[": 1, "{": 0, "": 0}.get(splits[0]["head"])
        mine, inside, depth, tail, least = {}, False, 0, 0, []
        for r in splits:
            case, last = "in" if inside else "out", r is splits[-1]
            mine[file[0], r["block_start"]] = Start(inside, depth, base or 0, last)
            least += [depth + x for x in (r[f"least_{case}"], None if last else r[f"depth_{case}"]) if x is not None]
            tail, depth, inside = depth + r[f"tail_{case}"], depth + r[f"depth_{case}"], inside != r["flips"]
        # The text after the last brace of a file counts as closed by one too.
        closed = tail == 0 or (base == 0 and depth == 0)
        if base is not None and closed and not inside and min(least, default=base) >= base:
            starts |= mine
        else:
            damaged.append(file)
    return starts, damaged


def _cut(batches, starts: dict[tuple, Start], pieces: bool):
    """The records of whole files that lie in one split, or else the pieces of the others.

    A piece that goes on with an earlier one has ordinal -1.
    """
    place, start, state, held = None, None, None, None

    def row(ordinal: int, texts: list[str]) -> pa.RecordBatch:
        return _batch(PIECE, [{**place, "ordinal": ordinal, "value": "".join(x + END for x in texts), "base": start.base}])

    def rest():
        """What is left at the end of a split: the text after a file's last record, or the beginning of a record."""
        if held is not None and pieces != (start.last and held[0] >= 0):
            yield row(*held)

    for batch in batches:
        text, ordinals = batch.column("value"), batch.column("ordinal")
        for i, j, here in _stretches(batch):
            if here != place:
                yield from rest()
                place, held, start = here, None, starts.get((here["source_path"], here["block_start"]))
                if start is not None:
                    state = _State(start.inside, start.depth)
                    held = (-1, []) if start.in_record else None
            if start is None:
                continue
            _, after, closes = state.over(batch, i, j)
            ends = np.flatnonzero(closes & (after == start.base))
            first = np.append(0, ends[:-1] + 1)[: len(ends)]
            done = int(ends[-1]) + 1 if len(ends) else 0
            if len(ends) and held is not None:
                if (held[0] < 0) == pieces:
                    yield row(held[0], held[1] + text.slice(i, int(ends[0]) + 1).to_pylist())
                held, first, ends = None, first[1:], ends[1:]
            if not pieces and len(ends):
                yield _records(batch, i + first, i + ends, start.base)
            if done < j - i:
                tail = text.slice(i + done, j - i - done).to_pylist()
                held = (held[0], held[1] + tail) if held is not None else (ordinals[i + done].as_py(), tail)
    yield from rest()


def _records(batch: pa.RecordBatch, first: np.ndarray, last: np.ndarray, base: int) -> pa.RecordBatch:
    """The records of the fragments from first to last."""
    rows = batch.take(pa.array(first)).select([*PLACE, "ordinal", "value"])
    value = pc.binary_join_element_wise(rows.column("value"), pa.scalar(END), "")
    several = np.flatnonzero(first != last)
    if len(several):
        text = value.to_pylist()
        for k in several.tolist():
            text[k] = "".join(x + END for x in batch.column("value").slice(first[k], last[k] - first[k] + 1).to_pylist())
        value = pa.array(text, pa.string())
    columns = [*(rows.column(n) for n in (*PLACE, "ordinal")), value.cast(pa.string()), pa.array(np.full(len(first), base, np.int32))]
    return pa.RecordBatch.from_arrays(columns, names=[*PLACE, "ordinal", "value", "base"])


def _stitched(pieces: DataFrame) -> DataFrame:
    """Records whose pieces lie in several splits. There are at most two pieces a split."""
    order = [F.col("block_start"), F.col("ordinal")]
    upto = Window.partitionBy("source_path").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begun = F.count_if(F.col("ordinal") >= 0).over(upto).alias("record")
    piece = F.struct(*order, "value", "base")
    records = pieces.select("*", begun).groupBy("source_path", "source_file", "record").agg(F.sort_array(F.collect_list(piece)).alias("pieces"))
    head = F.col("pieces")[0]
    return records.select(
        "source_path", "source_file", head["block_start"].alias("block_start"), head["ordinal"].alias("ordinal"),
        F.array_join("pieces.value", "").alias("value"), head["base"].alias("base"),
    )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of JSON array files as text, each with its place; a damaged one is no JSON."""
    fragments = _fragments(spark, path)
    # One small row a split.
    starts, damaged = starts_of(fragments.mapInArrow(_summaries, SUMMARY).collect())
    sent = spark.sparkContext.broadcast(starts)
    records = fragments.mapInArrow(lambda batches: _cut(batches, sent.value, False), PIECE)
    if any(s.in_record for s in starts.values()):
        records = records.unionByName(_stitched(fragments.mapInArrow(lambda batches: _cut(batches, sent.value, True), PIECE)))
    text = F.regexp_replace("value", "^﻿", "")
    before = F.substring_index(text, "{", 1)
    # Before a record stands the bracket of the array or a comma, or nothing at the top level.
    begins = F.when(F.col("base") == 1, F.rlike(before, F.lit(r"^\s*[\[,]\s*$"))).otherwise(F.rlike(before, F.lit(r"^\s*$")))
    sound = F.contains(text, F.lit("{")) & begins
    value = F.when(sound, F.substring(text, F.char_length(before) + 1, F.char_length(text))).otherwise(F.lit(DAMAGED))
    nothing = F.rlike(text, F.lit(r"^\s*(\[\s*)?(\]\s*)?\}$"))
    found = records.filter(~nothing).select(*PLACE, "ordinal", value.alias("value"))
    bad = [(p, n, 0, 0, DAMAGED) for p, n in damaged]
    return found.unionByName(spark.createDataFrame(bad, f"{_PLACE}, ordinal bigint, value string"))
