"""Stored tables as partitioned parquet.

Feeds are partitioned by period, customers by a hash of their id and documents by date, so a merge
reads and rewrites only the partitions its batch touches. A merge is first written beside
the tables and then put in place: the place being written is never the one being read. A merge that
was staged in full but not put in place completely is put in place by the next merge of its table,
before that reads anything; the next merge's own batch is then merged as always. With a
transactional table format ``upsert`` would be one MERGE.

The hash buckets of the customers grow with the table by linear hashing: one bucket more takes the rows of a
single older one, so all others stay as they are.

Documents of a few customers are better added (``add``) than merged: the rows go beside the table with a version, and
readers take the newest of each key until ``fold`` merges them.
"""

from __future__ import annotations

import threading
import uuid
import zlib
from collections.abc import Sequence
from datetime import date, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from altcredit.functions.times import instant
from altcredit.operators import upsert as up
from altcredit.operators.registry import FEEDS
from altcredit.schemas import CUSTOMER, TABLES
from altcredit.sources import paths

LOGS = ("data_lineage", "validation_errors")
DOCUMENTS = ("scorecards", "ai_reports")
DOCUMENT_KEYS = ("customer_id", "scorecard_date")
MIN_BUCKETS = 32
#: Customers for which there is one bucket.
BUCKET_ROWS = 500_000
#: Added batches of a table that are folded into it.
MOST_ADDED = 20
_VERSION = "_version"
_DYNAMIC = ("partitionOverwriteMode", "dynamic")


def bucket_of(key: Column, buckets: int) -> Column:
    """Bucket of a key by linear hashing; ``buckets`` need not be a power of two."""
    wide = 1 << (buckets - 1).bit_length()
    place = F.pmod(F.xxhash64(key), F.lit(wide))
    return F.when(place < buckets, place).otherwise(F.pmod(place, F.lit(max(1, wide // 2)))).cast("int")


def split_buckets(buckets: int, grown: int) -> set[int]:
    """The buckets that give rows away when their number grows."""
    origins = set()
    for new in range(buckets, grown):
        while new >= buckets:
            new -= 1 << (new.bit_length() - 1)
        origins.add(new)
    return origins


#: Up to so many ids are looked up by value, which files can be skipped by; beyond, ids are joined.
MOST_IDS = 1000


def clustered(rows: DataFrame, by: Sequence[Column | str]) -> DataFrameWriter:
    """A writer of rows that lie by customer within each partition of ``by``.

    Big partitions are split over several files and small ones kept in one; each file is sorted by customer, so
    the page index narrows a lookup to few pages, and has a Bloom filter over the customers, so a lookup
    passes over row groups that lack them.
    """
    if CUSTOMER not in rows.columns:
        return rows.hint("rebalance", *by).write
    ordered = rows.hint("rebalance", *by).sortWithinPartitions(*by, CUSTOMER)
    return ordered.write.option(f"parquet.bloom.filter.enabled#{CUSTOMER}", "true")


def of_customers(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of some customers. The ids of a few are put into the scan, those of many are joined."""
    few = [r[0] for r in ids.select(CUSTOMER).distinct().limit(MOST_IDS + 1).collect()]
    if len(few) <= MOST_IDS:
        return rows.filter(F.col(CUSTOMER).isin([i for i in few if i is not None]))
    return rows.join(ids.select(CUSTOMER).distinct(), CUSTOMER, "left_semi")


class TableStore:
    """Tables below ``root``; with ``sums`` their loads also keep block sums (``sources.sums``)."""

    def __init__(self, spark: SparkSession, root: str, sums: bool = False) -> None:
        self.spark = spark
        self.root = root.rstrip("/")
        self.sums = sums
        # Feeds that are loaded at the same time share the log tables, which have one writer at a time.
        self._logging = threading.Lock()

    def path(self, table: str) -> str:
        if table not in TABLES:
            raise ValueError(f"Unknown table_name: {table}")
        return f"{self.root}/{table}"

    def fresh_path(self, name: str) -> str:
        """A new place for an intermediate result."""
        return self.working_path(f"{name}-{uuid.uuid4().hex}")

    def staged_path(self, table: str) -> str:
        """Where a merge waits to be put in place; beside the tables, as it may outlive a run."""
        return f"{self.root}/_staged/{table}"

    def working_path(self, *names: str) -> str:
        """A place for intermediate results; stores sharing a working folder keep apart."""
        base = paths.working_folder(self.spark, f"{self.root}/_work")
        return "/".join([base, paths.as_name(self.root), *names])

    def partition_columns(self, table: str) -> dict[str, Column]:
        if table in LOGS:
            return {"run_id": F.col("run_id")}
        if table == "customers":
            return {"bucket": bucket_of(F.col(CUSTOMER), self.buckets())}
        if table in FEEDS:
            return FEEDS[table].partition_by()
        return {"scorecard_date": F.col("scorecard_date")}

    def buckets(self) -> int:
        """The number of customer buckets; each growth leaves a mark."""
        return max([MIN_BUCKETS, *map(int, paths.names_below(self.spark, self._marks))])

    @property
    def _marks(self) -> str:
        return f"{self.root}/_buckets"

    def keys(self, table: str) -> Sequence[str]:
        return FEEDS[table].keys if table in FEEDS else DOCUMENT_KEYS

    def _stored_schema(self, table: str) -> T.StructType:
        extra = {"run_id": T.StringType(), "txn_month": T.DateType(), "bucket": T.IntegerType()}
        fields = list(TABLES[table].fields)
        for name in self.partition_columns(table):
            if name not in TABLES[table].names:
                fields.append(T.StructField(name, extra[name]))
        return T.StructType(fields)

    def create_tables(self) -> None:
        """Creates the tables that do not exist yet, empty."""
        for table, schema in TABLES.items():
            if not paths.exists(self.spark, self.path(table)):
                self.spark.createDataFrame([], schema).write.parquet(self.path(table))

    def _read_stored(self, table: str) -> DataFrame:
        return self.spark.read.schema(self._stored_schema(table)).parquet(self.path(table))

    def read(self, table: str) -> DataFrame:
        stored = self._read_stored(table).select(*TABLES[table].names)
        added = self._added(table)
        return self._with_added(stored, added, table) if added else stored

    def _added(self, table: str) -> list[str]:
        """The places of the batches that were added since the last fold."""
        if table not in DOCUMENTS:
            return []
        return [f for f in paths.folders_below(self.spark, self._added_path(table)) if paths.finished(self.spark, f)]

    def _added_path(self, table: str) -> str:
        return f"{self.root}/_added/{table}"

    def _read_added(self, table: str, places: list[str]) -> DataFrame:
        schema = T.StructType([*TABLES[table].fields, T.StructField(_VERSION, T.LongType())])
        return self.spark.read.schema(schema).parquet(*places)

    def _with_added(self, stored: DataFrame, places: list[str], table: str) -> DataFrame:
        """The stored rows with the newest of the added ones in place of theirs.

        Every added batch is unique on the key. What is joined are keys; a stored document moves only
        if it stays.
        """
        keys, added = list(self.keys(table)), self._read_added(table, places)
        newest = added.groupBy(*keys).agg(F.max(_VERSION).alias(_VERSION))
        fresh = added.join(newest, [*keys, _VERSION])
        if "created_at" in TABLES[table].names:
            # The oldest row's stamp stays, as in a merge.
            first = added.groupBy(*keys).agg(F.min_by("created_at", _VERSION).alias("_first"))
            old = stored.select(*keys, F.col("created_at").alias("_old"))
            fresh = fresh.join(first, keys).join(old, keys, "left").withColumn("created_at", F.coalesce("_old", "_first"))
        kept = stored.join(newest.select(*keys), keys, "left_anti")
        return kept.select(*TABLES[table].names).unionByName(fresh.select(*TABLES[table].names))

    def add(self, batch: DataFrame, table: str, run_ts: datetime) -> None:
        """Adds documents, unique on the key, as the newest of theirs. Writes the batch and nothing else."""
        places = self._added(table)
        if len(places) >= MOST_ADDED:
            self.fold(table)
        taken = [int(paths.name_of(f)) for f in paths.folders_below(self.spark, self._added_path(table))]
        version = max(taken, default=0) + 1
        given = {n: F.col(n) for n in batch.columns} | {"created_at": instant(run_ts)}
        rows = batch.select(*[given[f.name].cast(f.dataType).alias(f.name) for f in TABLES[table].fields], F.lit(version).cast("long").alias(_VERSION))
        rows.write.mode("overwrite").parquet(f"{self._added_path(table)}/{version:012d}")

    def fold(self, table: str) -> None:
        """Merges the added documents into the table; rewrites the dates that they belong to."""
        staged = self.staged_path(table)
        self._complete(table, staged)
        places = self._added(table)
        if not places:
            return
        stored = self._read_stored(table).filter(self._touched(self._read_added(table, places), self.partition_columns(table)))
        merged = self._with_added(stored.select(*TABLES[table].names), places, table)
        merged.write.mode("overwrite").parquet(staged)
        self._complete(table, staged)
        # Folded twice they would give the same rows.
        for place in places:
            paths.discard(self.spark, place)

    def read_blocks(self, table: str, blocks: list[int]) -> DataFrame:
        """The rows of some blocks of time (years, or months of daily rows); other periods are not read."""
        if "txn_month" in self.partition_columns(table):
            months = [date(b // 12, b % 12 + 1, 1) for b in blocks]
            chosen = F.col("txn_month").isin(months)
        else:
            chosen = F.col("year").isin(blocks)
        return self._read_stored(table).filter(chosen).select(*TABLES[table].names)

    def append(self, rows: DataFrame, table: str, run_id: str, source: str) -> None:
        """Adds a load's log rows; repeating the load replaces them, also by none at all."""
        shaped = rows.select(*[F.col(f.name).cast(f.dataType) for f in TABLES[table].fields])
        of = f"{paths.as_name(run_id)}-{zlib.crc32(f'{run_id}|{source}'.encode()):08x}"
        with self._logging:
            paths.discard(self.spark, f"{self.path(table)}/run_id={of}")
            shaped.withColumn("run_id", F.lit(of)).write.mode("append").partitionBy("run_id").parquet(self.path(table))

    def _touched(self, batch: DataFrame, parts: dict[str, Column]) -> Column:
        """Condition selecting the partitions a batch touches, for static partition pruning.

        The list is bounded by the calendar (months, or scorecard dates), not by the data.
        """
        distinct = batch.select(*[c.alias(n) for n, c in parts.items()]).distinct().collect()
        if not distinct:
            return F.lit(False)
        if len(parts) == 1:
            (name,) = parts
            return F.col(name).isin([row[0] for row in distinct])
        outer, inner = parts
        months: dict[object, list[object]] = {}
        for row in distinct:
            months.setdefault(row[outer], []).append(row[inner])
        tests = [(F.col(outer) == o) & F.col(inner).isin(i) for o, i in months.items()]
        return reduce(lambda a, b: a | b, tests)

    def upsert(self, batch: DataFrame, table: str, run_ts: datetime) -> None:
        """Merges a batch that is unique on the table's key."""
        if self._added(table):
            self.fold(table)
        staged = self.staged_path(table)
        self._complete(table, staged)
        grown = self._grown() if table == "customers" else 0
        self._merged(batch, table, run_ts, grown).write.mode("overwrite").parquet(staged)
        if grown:
            # Without this mark the staged rows go into the buckets that there were.
            paths.mark(self.spark, f"{staged}/_buckets/{grown}")
        self._complete(table, staged)

    def _grown(self) -> int:
        """The number of customer buckets that the table needs, if that is more than it has.

        Rows are counted from the files' footers, before the batch: a table grows one merge later.
        """
        needed = -(-self._read_stored("customers").count() // BUCKET_ROWS)
        return needed if needed > self.buckets() else 0

    def _complete(self, table: str, staged: str) -> None:
        """Puts a merge in place that was staged in full."""
        if paths.finished(self.spark, staged):
            self._put_in_place(table, staged)
            paths.discard(self.spark, staged)

    def _merged(self, batch: DataFrame, table: str, run_ts: datetime, grown: int = 0) -> DataFrame:
        """The new content of the partitions that a batch touches, and of the buckets that are split."""
        schema, parts = TABLES[table], self.partition_columns(table)
        shaped = batch.select(
            *[F.col(f.name).cast(f.dataType) for f in schema.fields if f.name in batch.columns]
        )
        stored = self._read_stored(table)
        if parts:
            chosen = self._touched(shaped, parts)
            if grown:
                chosen |= F.col("bucket").isin(list(split_buckets(self.buckets(), grown)))
            stored = stored.filter(chosen)
        return up.merge(stored.select(*schema.names), shaped, self.keys(table), run_ts)

    def _put_in_place(self, table: str, staged: str) -> None:
        schema, parts = TABLES[table], self.partition_columns(table)
        ready = self.spark.read.schema(schema).parquet(staged)
        grown = max(map(int, paths.names_below(self.spark, f"{staged}/_buckets")), default=0)
        if grown:
            parts = {"bucket": bucket_of(F.col(CUSTOMER), grown)}
        ready = ready.withColumns({n: c for n, c in parts.items() if n not in schema.names})
        writer = clustered(ready, [*parts]).option(*_DYNAMIC).partitionBy(*parts)
        writer.mode("overwrite").parquet(self.path(table))
        if grown:
            # A bucket that gave all of its rows away has been written by nobody.
            written = {r[0] for r in ready.select("bucket").distinct().collect()}
            for bucket in split_buckets(self.buckets(), grown) - written:
                paths.discard(self.spark, f"{self.path(table)}/bucket={bucket}")
            paths.mark(self.spark, f"{self._marks}/{grown}")
