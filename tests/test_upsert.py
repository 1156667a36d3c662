from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from altcredit.operators import listing, upsert

OLD, NEW = datetime(2024, 1, 1), datetime(2025, 1, 1)


def test_merge_keeps_created_at_and_replaces_values(spark):
    ddl = "k string, v int, created_at timestamp, updated_at timestamp"
    stored = spark.createDataFrame([("a", 1, OLD, OLD), ("b", 2, OLD, OLD)], ddl)
    batch = spark.createDataFrame([("b", None), ("c", 3)], "k string, v int")
    rows = {r.k: (r.v, r.created_at, r.updated_at) for r in upsert.merge(stored, batch, ["k"], NEW).collect()}
    assert rows == {"a": (1, OLD, OLD), "b": (None, OLD, NEW), "c": (3, NEW, NEW)}
    again = upsert.merge(upsert.merge(stored, batch, ["k"], NEW), batch, ["k"], NEW)
    assert {r.k: (r.v, r.created_at, r.updated_at) for r in again.collect()} == rows


def test_hot_key(spark):
    """One key with a third of all rows: the last one wins, nothing is dropped elsewhere."""
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"),
        F.col("id").alias("ordinal"),
        (F.col("id") * 2).alias("v"),
    )
    last = upsert.last_per_key(rows.repartition(8, F.rand(1)), ["k"], ["ordinal"])
    assert last.count() == 20_001
    assert last.filter("k = -1").collect()[0].v == 29_997 * 2
    assert last.filter("k >= 0 and v <> 2 * k").isEmpty()


def test_latest_per_customer_and_lookup(spark):
    stored = spark.createDataFrame(
        [("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 1, "q")], "customer_id string, d int, v string"
    )
    newest = {r.customer_id: (r.d, r.v) for r in listing.latest_per_customer(stored, "d", "v").collect()}
    assert newest == {"a": (3, "z"), "b": (1, "q")}
    people = spark.createDataFrame(
        [("a", "A", "S", "G", None)], "customer_id string, business_name string, sector string, gst_number string, persona string"
    )
    known, unknown = listing.lookup_customers(stored, people)
    assert [r.business_name for r in known.collect()] == ["A"]
    assert [r.customer_id for r in unknown.collect()] == ["b"]
