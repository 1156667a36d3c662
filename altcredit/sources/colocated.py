"""Stored tables published as tables bucketed by customer, so that scoring shuffles nothing.

All published tables have the same number of buckets and lie sorted by customer. Per-customer sums, their joins and
the join with the customers then work inside a bucket; Spark plans them without an exchange. Publishing
shuffles each table once; it pays where tables are scored more often than they change. A hot customer is one
task's, as in any grouping by customer, and bounded by its natural keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from altcredit.operators import partials as pt
from altcredit.operators import summaries as sm
from altcredit.schemas import CUSTOMER
from altcredit.sources.store import TableStore

PUBLISHED = ("customers", *pt.SUMMED)


def name_of(table: str, prefix: str) -> str:
    return f"{prefix}_{table}"


def publish(store: TableStore, prefix: str, buckets: int, tables: tuple[str, ...] = PUBLISHED) -> None:
    """Writes the tables into the catalog; replaces what was published under the prefix."""
    for table in tables:
        # Dealt like the buckets, so each task writes one file of one bucket.
        rows = store.read(table).repartition(buckets, CUSTOMER)
        writer = rows.write.bucketBy(buckets, CUSTOMER).sortBy(CUSTOMER)
        writer.mode("overwrite").format("parquet").saveAsTable(name_of(table, prefix))


def read(spark: SparkSession, table: str, prefix: str) -> DataFrame:
    return spark.table(name_of(table, prefix))


def summaries(spark: SparkSession, prefix: str) -> list[DataFrame]:
    """Sums of all published sources."""
    monthly = [sm.summarize_monthly(read(spark, t, prefix), [source]) for t, source in pt.SOURCES.items()]
    return [*monthly, sm.summarize_upi(read(spark, pt.DAILY, prefix))]
