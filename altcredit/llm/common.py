"""What the operators share on the driver's side."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: One or more of these separates words: space, tab, line feed, vertical tab, form feed, return.
WHITE = r"[\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_of(column: str) -> Column:
    """The text, empty for a null."""
    return F.coalesce(F.col(column), F.lit(""))


def words_of(column: str) -> Column:
    """The words of a text, in order; none for a null."""
    return F.array_remove(F.split(text_of(column), WHITE), "")


def utf8_bytes(column: str) -> Column:
    return F.coalesce(F.octet_length(F.col(column)), F.lit(0)).cast("long")


def checkpoint_folder(spark: SparkSession) -> None:
    """Keeps the cluster's shared folder; names one only where all executors run on this machine."""
    context = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", None) is None and context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir("/tmp/checkpoints")


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Bounds what an Arrow batch holds when texts are long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def total_bytes(docs: DataFrame, text: str) -> int:
    return docs.agg(F.sum(utf8_bytes(text)).alias("n")).first()["n"] or 0


def pieces_of(size: int, each: int, least: int = 1) -> int:
    return max(least, math.ceil(size / each))


def scratch(spark: SparkSession, name: str) -> str:
    """A new place for an intermediate table in the folder that all executors share."""
    checkpoint_folder(spark)
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{folder.rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


#: Places of the intermediate tables that this process has made.
_WRITTEN: list[str] = []
#: Removes a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(frame: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: its lineage ends there, its shuffle files go."""
    spark, path = frame.sparkSession, scratch(frame.sparkSession, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        frame.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    _WRITTEN.append(path)
    return spark.read.schema(frame.schema).parquet(path)


def tables_written() -> list[str]:
    """The places of the tables that ``written`` has made and ``release`` hasn't removed."""
    return list(_WRITTEN)


def release(spark: SparkSession, *keep: str) -> None:
    """Removes the tables that ``written`` has made, but for those to keep.

    An operator's result may read them until it is computed; call this after that.
    """
    for path in [p for p in _WRITTEN if p not in keep]:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        _WRITTEN.remove(path)


def packed(docs: DataFrame, **columns: str) -> DataFrame:
    """The named columns under new names, and the whole input row as struct ``row``."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(*[F.col(f"`{c}`").alias(name) for name, c in columns.items()], row)


def schema(frame: DataFrame, names: list[str], ddl: str) -> StructType:
    """Fields of a frame as they are, then those of a DDL string."""
    return StructType([frame.schema[n] for n in names] + StructType.fromDDL(ddl).fields)


def unpacked(frame: DataFrame, docs: DataFrame, **columns: Column) -> DataFrame:
    """The input's columns out of ``row`` and new ones; an input column of a new one's name is replaced."""
    kept = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in columns]
    return frame.select(*kept, *[c.alias(name) for name, c in columns.items()])
