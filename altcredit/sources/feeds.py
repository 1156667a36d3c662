"""Readers of feed files. Every raw field is read as text under the declared schema.

A reader returns the raw fields plus ``source_path``, ``source_file``, ``corrupt`` and the two
columns that give the order of records within a file (``block_start``, ``ordinal``).
"""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from altcredit.operators.registry import FeedSpec
from altcredit.sources import arrays, paths

CORRUPT = "_corrupt_record"
ORDER = ("source_path", "block_start", "ordinal")
POSITION = ("source_path", "source_file", "block_start", "ordinal")
FORMATS = ("json", "jsonl", "csv")


def _with_position(raw: DataFrame, spec: FeedSpec, corrupt: Column) -> DataFrame:
    return raw.select(
        *[f.raw for f in spec.fields],
        F.col("_metadata.file_path").alias("source_path"),
        F.col("_metadata.file_name").alias("source_file"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("ordinal"),
        corrupt.alias("corrupt"),
    )


def json_schema(spec: FeedSpec) -> T.StructType:
    return T.StructType([*spec.raw_schema.fields, T.StructField(CORRUPT, T.StringType())])


#: Options of the reader of JSON array files.
ARRAY_OPTIONS = {
    "multiLine": "true",
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": CORRUPT,
    "encoding": "UTF-8",
}


def positioned_json(raw: DataFrame, spec: FeedSpec) -> DataFrame:
    return _with_position(raw, spec, F.col(CORRUPT).isNotNull())


def parsed_lines(lines: DataFrame, spec: FeedSpec, value: str = "value") -> DataFrame:
    """The raw fields of the records in text lines, ``corrupt``, and the other columns of ``lines``.

    A line holds one JSON object, or an array of them. A line that can't be parsed, and an array
    element that is no object, is one row with all fields NULL and ``corrupt`` true; blank lines
    hold no record.
    """
    rest = [c for c in lines.columns if c != value]
    records = F.from_json(value, T.ArrayType(spec.raw_schema))
    every = F.when(records.isNull(), F.array(F.lit(None).cast(spec.raw_schema))).otherwise(records)
    found = lines.filter(F.trim(value) != "").select(*rest, F.explode(every).alias("_record"))
    corrupt = F.col("_record").isNull().alias("corrupt")
    return found.select(*rest, *[F.col("_record")[f.raw].alias(f.raw) for f in spec.fields], corrupt)


def read_whole_json(spark: SparkSession, path: str, spec: FeedSpec) -> DataFrame:
    """JSON array files, each by one task that holds it in memory; one that is not valid is a single corrupt row."""
    return positioned_json(spark.read.schema(json_schema(spec)).options(**ARRAY_OPTIONS).json(path), spec)


def read_json(spark: SparkSession, path: str, spec: FeedSpec) -> DataFrame:
    """JSON array files; files are split (see ``arrays``). A damaged record is a corrupt row."""
    records = parsed_lines(arrays.read_records(spark, path), spec)
    return records.select(*[f.raw for f in spec.fields], *POSITION, "corrupt")


def positioned_lines(lines: DataFrame, spec: FeedSpec) -> DataFrame:
    """Records of text lines that carry their file's metadata."""
    return _with_position(parsed_lines(lines.select("value", "_metadata"), spec), spec, F.col("corrupt"))


def read_lines(spark: SparkSession, path: str, spec: FeedSpec) -> DataFrame:
    """JSON lines; files are split."""
    return positioned_lines(spark.read.option("encoding", "UTF-8").text(path), spec)


def _csv_schema(names: list[str]) -> T.StructType:
    fields = [T.StructField(n, T.StringType()) for n in names]
    return T.StructType([*fields, T.StructField(CORRUPT, T.StringType())])


def read_csv(spark: SparkSession, path: str, spec: FeedSpec) -> DataFrame:
    """CSV with a header in each file: fields are taken by their name there, all as text.

    Only the header lines are read on the driver. Files with the same header are one scan. A line
    with more or fewer fields than its header is one corrupt row.
    """
    absent = F.lit(None).cast("string")
    by_header: dict[tuple[str, ...], list[str]] = {}
    for file, line in paths.first_lines(spark, path).items():
        by_header.setdefault(tuple(_header(line)), []).append(file)
    parts = []
    for names, files in by_header.items():
        raw = spark.read.schema(_csv_schema(list(names))).csv(
            files, header=True, encoding="UTF-8", mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, enforceSchema=True
        )
        raw = raw.withColumns({f.raw: absent for f in spec.fields if f.raw not in names})
        parts.append(_with_position(raw, spec, F.col(CORRUPT).isNotNull()))
    if not parts:  # no file has a line
        nothing = spark.read.schema(_csv_schema([f.raw for f in spec.fields])).csv(path, header=True)
        return _with_position(nothing, spec, F.lit(False))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _header(line: str) -> list[str]:
    """Names in a header line; a name that comes twice is taken once."""
    names: list[str] = []
    for i, name in enumerate(next(csv.reader([line]), [])):
        names.append(name if name not in names else f"_again_{i}")
    return names


def read_feed(spark: SparkSession, path: str, spec: FeedSpec, fmt: str = "json") -> DataFrame:
    if fmt not in FORMATS:
        raise ValueError(f"unknown feed format {fmt!r}, expected one of {FORMATS}")
    reader = {"csv": read_csv, "jsonl": read_lines, "json": read_json}[fmt]
    return reader(spark, path, spec)


def feed_files(spark: SparkSession, path: str) -> DataFrame:
    """The files of a feed, empty ones included; contents are not read."""
    # Named through the same metadata as the records, so that both spell a path alike. Scans leave
    # out files without a byte.
    listed = spark.read.format("binaryFile").load(path).select(
        F.col("_metadata.file_path").alias("source_path"),
        F.col("_metadata.file_name").alias("source_file"),
    )
    empty = [(f, paths.name_of(f)) for f, size in paths.files_below(spark, path).items() if not size]
    return listed.unionByName(spark.createDataFrame(empty, "source_path string, source_file string"))
