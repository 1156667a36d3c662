"""Published tables are scored without an exchange."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from altcredit.operators import validate as vd
from altcredit.plans import scorecard as sc
from altcredit.sources import colocated
from altcredit.sources.store import TableStore
from tests import samples as s


@pytest.fixture
def published(spark, folder):
    before = spark.conf.get("spark.sql.warehouse.dir")
    spark.sql(f"create database if not exists colocated_tests location '{folder}/tables'")
    spark.sql("use colocated_tests")
    store = TableStore(spark, f"{folder}/store")
    store.create_tables()
    ids = spark.range(40).select(F.format_string("C%02d", "id").alias("customer_id"))
    store.upsert(s.whole_rows(ids, "customers"), "customers", s.RUN_TS)
    months = ids.crossJoin(spark.range(1, 7).select(F.col("id").cast("int").alias("month"))).withColumn("year", F.lit(2024))
    amount = (F.xxhash64("customer_id", "month") % 1000 + 1000).cast("long")
    store.upsert(s.whole_rows(months.withColumn("gstr_sales_paise", amount), "gst_filings"), "gst_filings", s.RUN_TS)
    store.upsert(s.whole_rows(months.withColumn("total_credits_paise", amount), "bank_statements"), "bank_statements", s.RUN_TS)
    store.upsert(s.whole_rows(months.withColumn("employee_count", amount.cast("int")), "epfo_payroll"), "epfo_payroll", s.RUN_TS)
    days = ids.withColumn("txn_date", F.lit(s.AS_OF)).withColumn("collections_paise", F.lit(5).cast("long"))
    store.upsert(s.whole_rows(days, "upi_transactions"), "upi_transactions", s.RUN_TS)
    colocated.publish(store, "t", 4)
    yield store
    spark.sql("use default")
    spark.sql("drop database colocated_tests cascade")
    assert spark.conf.get("spark.sql.warehouse.dir") == before


def _text(cards):
    return sorted(json.dumps(r.asDict(True), default=str) for r in cards.collect())


def test_scoring_published_tables_shuffles_nothing(spark, published):
    cards = sc.scorecards_of_sums(colocated.read(spark, "customers", "t"), colocated.summaries(spark, "t"), s.AS_OF)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = sc.scorecards_of_sums(colocated.read(spark, "customers", "t"), colocated.summaries(spark, "t"), s.AS_OF)
        assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
        found = _text(plan)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    feeds = [published.read(t) for t in ("gst_filings", "upi_transactions", "bank_statements", "epfo_payroll")]
    assert found == _text(sc.scorecards(published.read("customers"), *feeds, s.AS_OF)) == _text(cards)
    assert len(found) == 40


def test_feeds_side_by_side_are_checked_like_single_ones(spark):
    banks, staff = [s.bank("C1"), s.bank("", 13), s.bank("C2", dscr="x")], [s.epfo("C1"), s.epfo("C1", 2, employee_count=0), s.epfo(None)]
    raws = {"bank_statements": s.raw_frame(spark, banks, [*s.bank()]), "epfo_payroll": s.raw_frame(spark, staff, [*s.epfo()])}
    pairs = [raw.select(F.struct("*").alias(t), F.monotonically_increasing_id().alias(f"_{t}")).coalesce(1) for t, raw in raws.items()]
    numbered = [p.select(t, F.row_number().over(ordered_by(f"_{t}")).alias("n")) for p, t in zip(pairs, raws)]
    rows = numbered[0].join(numbered[1], "n").drop("n")
    found = vd.check_feeds(rows, tuple(raws), s.AS_OF).collect()
    want = [(t, r.record_id, r.blocking, r.warnings) for t, raw in raws.items() for r in vd.check_feed(raw, t, s.AS_OF).collect()]
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, want))


def ordered_by(name):
    from pyspark.sql import Window

    return Window.orderBy(name)
