"""Stored block sums, kept up to date by loads, and the customers whose data changed.

A load first notes which blocks of which customers its batch touches (``note``), then merges the batch, then
brings the sums of those blocks up to date (``refresh``): the touched periods are read again, no others. A note
goes once its blocks are done; if a run dies in between, the next refresh does what the note says, so
sums never stay behind the tables. The customers of notes that are done wait in ``changed`` until they
have been scored.

Blocks lie in one folder each, sorted by customer (see ``store.clustered``). A table's sums have one writer at
a time, like the table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from altcredit.operators import partials as pt
from altcredit.schemas import CUSTOMER
from altcredit.sources import paths
from altcredit.sources.store import TableStore, clustered

NOTE = f"{CUSTOMER} string, {pt.BLOCK} int"


def _folder(store: TableStore, *names: str) -> str:
    return "/".join([store.root, "_sums", *names])


def _notes(store: TableStore, *names: str) -> list[str]:
    """The finished notes of a kind."""
    return [f for f in paths.folders_below(store.spark, _folder(store, *names)) if paths.finished(store.spark, f)]


def note(store: TableStore, table: str, batch: DataFrame) -> None:
    """Writes down whom a batch is about, before it is merged."""
    if table in pt.SUMMED:
        touched = batch.select(CUSTOMER, pt.block_of(table).cast("int").alias(pt.BLOCK)).distinct()
    else:
        touched = batch.select(CUSTOMER, F.lit(None).cast("int").alias(pt.BLOCK)).distinct()
    touched.write.parquet(_folder(store, "notes", table, uuid.uuid4().hex))


def read(store: TableStore, table: str) -> DataFrame:
    """The block sums of a table."""
    schema, path = pt.block_schema(store.spark, table), _folder(store, "blocks", table)
    if not paths.exists(store.spark, path):
        return store.spark.createDataFrame([], schema)
    return store.spark.read.schema(schema).parquet(path).select(*schema.names)


def _write(store: TableStore, table: str, rows: DataFrame) -> None:
    blocks = clustered(pt.block_sums(rows, table), [pt.BLOCK])
    blocks.option("partitionOverwriteMode", "dynamic").partitionBy(pt.BLOCK).mode("overwrite").parquet(_folder(store, "blocks", table))


def rebuild(store: TableStore) -> None:
    """All sums from all rows, for a store that was filled without them."""
    for table in pt.SUMMED:
        _write(store, table, store.read(table))


def refresh(store: TableStore, table: str) -> None:
    """Does what the notes of a table say. Reads the periods of the touched blocks only."""
    notes = _notes(store, "notes", table)
    if not notes:
        return
    touched = store.spark.read.schema(NOTE).parquet(*notes)
    if table in pt.SUMMED:
        # Bounded by the calendar: at most 101 years, or 1212 months.
        blocks = sorted(r[0] for r in touched.select(pt.BLOCK).distinct().collect())
        _write(store, table, store.read_blocks(table, blocks))
    touched.select(CUSTOMER).distinct().write.parquet(_folder(store, "changed", uuid.uuid4().hex))
    for path in notes:
        paths.discard(store.spark, path)


def changed(store: TableStore) -> tuple[DataFrame, list[str]]:
    """Customers whose data changed since they were scored, and the places that say so."""
    for table in (*pt.SUMMED, "customers"):
        refresh(store, table)
    places = _notes(store, "changed")
    if not places:
        return store.spark.createDataFrame([], f"{CUSTOMER} string"), []
    return store.spark.read.schema(f"{CUSTOMER} string").parquet(*places).distinct(), places


def scored(store: TableStore, places: list[str]) -> None:
    """The changes in these places have been dealt with."""
    for path in places:
        paths.discard(store.spark, path)
