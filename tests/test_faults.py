"""Damaged records, repeated and interrupted loads, extreme values: nothing is lost and nothing stops."""

from __future__ import annotations

import json
from datetime import date, timedelta
from pathlib import Path

from pyspark.sql import functions as F

from altcredit.operators import listing
from altcredit.operators.registry import FEEDS
from altcredit.plans import load, reports
from altcredit.plans import scorecard as sc
from altcredit.sources import feeds, paths
from altcredit.sources.store import TableStore
from altcredit.streaming.feeds import stream_feed
from tests import samples as s

LATER = s.RUN_TS + timedelta(days=1)


def store_with_customers(spark, folder, *ids):
    store = TableStore(spark, f"{folder}/store")
    store.create_tables()
    path = s.write_feed(folder, "customers", [s.customer(i) for i in ids or ("C1", "C2")])
    load.load_feed(store, path, "customers", s.AS_OF, s.RUN_TS, "people")
    return store


def lines_file(folder, name, lines):
    path = Path(folder) / name
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))
    return str(path)


def test_damaged_lines_are_logged_and_counted(spark, folder):
    store = store_with_customers(spark, folder)
    good = s.year(s.epfo)
    lines = [*good[:5], '{"customer_id": "C1", "mon', *good[5:], "no json", "", "5", [s.epfo("C2"), s.epfo("C2", month=2)]]
    path = lines_file(folder, "epfo.jsonl", lines)
    (row,) = load.load_feed(store, path, "epfo_payroll", s.AS_OF, LATER, "run", "jsonl").collect()
    assert (row.attempted, row.loaded, row.skipped) == (17, 14, 3)
    (log,) = store.read("data_lineage").filter("table_name = 'epfo_payroll'").collect()
    assert (log.status, log.record_count, log.error_message) == ("PARTIAL", 14, "3 record(s) failed validation")
    errors = store.read("validation_errors").collect()
    assert [(r.record_identifier, r.error_reason) for r in errors] == [("UNKNOWN", "transform failed: damaged record")] * 3
    issues = load.validate_data(spark, folder, s.AS_OF, "jsonl")
    assert issues.filter("issue like '%damaged%'").count() == 0  # no file of that name


def test_dry_run_names_damaged_lines(spark, folder):
    lines_file(folder, "epfo_payroll.jsonl", [s.epfo(), "{"])
    issues = load.validate_data(spark, folder, s.AS_OF, "jsonl").filter("table_name = 'epfo_payroll'").collect()
    assert [r.issue for r in issues] == ["UNKNOWN: transform failed: damaged record"]


def test_two_loads_under_one_run_id_keep_both_logs(spark, folder):
    store = store_with_customers(spark, folder)
    one = s.write_feed(folder, "gst_filings", [s.gst(), s.gst(month=3, tax_paid=-1)])
    other = Path(folder) / "more"
    other.mkdir()
    two = s.write_feed(other, "gst_filings", [s.gst(month=2), s.gst(month=4, tax_paid=-1)])
    first = load.load_feed(store, one, "gst_filings", s.AS_OF, LATER, "run")
    second = load.load_feed(store, two, "gst_filings", s.AS_OF, LATER, "run")
    assert [r.loaded for r in first.collect() + second.collect()] == [1, 1]
    assert store.read("data_lineage").filter("table_name = 'gst_filings'").count() == 2
    assert {r.record_identifier for r in store.read("validation_errors").collect()} == {"C1:2024-03", "C1:2024-04"}
    # The same load again, now without errors, removes its own error rows only.
    s.write_feed(folder, "gst_filings", [s.gst()])
    load.load_feed(store, one, "gst_filings", s.AS_OF, LATER, "run")
    assert {r.record_identifier for r in store.read("validation_errors").collect()} == {"C1:2024-04"}
    assert store.read("data_lineage").filter("table_name = 'gst_filings'").count() == 2


def test_a_staged_merge_never_replaces_another_batch(spark, folder):
    store = store_with_customers(spark, folder)
    scores = "customer_id string, scorecard_date date, scorecard_json string, composite_score int"
    batch = lambda i, n: spark.createDataFrame([(i, s.AS_OF, "{}", n)], scores)
    store.upsert(batch("C1", 1), "scorecards", s.RUN_TS)
    # One run stages its merge and dies; the next one has another batch.
    store._merged(batch("C2", 2), "scorecards", s.RUN_TS).write.parquet(store.staged_path("scorecards"))
    store.upsert(batch("C1", 99), "scorecards", LATER)
    store.upsert(batch("C2", 2), "scorecards", LATER)
    assert {r.customer_id: r.composite_score for r in store.read("scorecards").collect()} == {"C1": 99, "C2": 2}
    assert not paths.exists(spark, store.staged_path("scorecards"))


def test_customers_merge_by_bucket(spark, folder):
    store = store_with_customers(spark, folder, "C1", "C2", "C3")
    path = s.write_feed(folder, "customers", [s.customer("C2", business_name="Renamed"), s.customer("C4")])
    load.load_feed(store, path, "customers", s.AS_OF, LATER, "again")
    names = {r.customer_id: r.business_name for r in store.read("customers").collect()}
    assert set(names) == {"C1", "C2", "C3", "C4"} and names["C2"] == "Renamed"


def test_extreme_numbers_block_a_row_and_nothing_else(spark, folder):
    store = store_with_customers(spark, folder)
    rows = [s.bank(month=1, dscr=-1e40), s.bank(month=2, dscr="-1e40"), s.bank(month=3)]
    rows += [s.bank(month=4, total_credits=9e16), s.bank(month=5, total_credits=-9.3e16)]
    path = s.write_feed(folder, "bank_statements", rows)
    (row,) = load.load_feed(store, path, "bank_statements", s.AS_OF, LATER, "run").collect()
    assert (row.attempted, row.loaded, row.skipped) == (5, 1, 4)
    reasons = [r.error_reason for r in store.read("validation_errors").collect()]
    assert sum("must be > 0" in r for r in reasons) == 2
    upi = s.upi_rows("C1")
    upi = [{**r, "collections": 9e16} for r in upi[:2]] + [{**r, "collections": 1e11} for r in upi[2:]]
    load.load_feed(store, s.write_feed(folder, "upi_transactions", upi), "upi_transactions", s.AS_OF, LATER, "run")
    assert store.read("upi_transactions").count() == len(upi) - 2
    reports.run_analytics(store, s.AS_OF, LATER, "score")
    assert store.read("scorecards").count() == 2


def test_broken_scorecards_are_returned(spark, folder):
    store = store_with_customers(spark, folder)
    reports.run_analytics(store, s.AS_OF, s.RUN_TS, "score")
    cards = store.read("scorecards").collect()
    text = {r.customer_id: r.scorecard_json for r in cards}["C2"]
    for broken in ("{", text[: len(text) // 2], text[:-2], "{}", None):
        bad = spark.createDataFrame([("C2", s.AS_OF, broken, 0)], "customer_id string, scorecard_date date, scorecard_json string, composite_score int")
        store.upsert(bad, "scorecards", LATER)
        (refused,) = reports.generate_reports(store, LATER, "report").collect()
        assert (refused.customer_id, refused.scorecard_date) == ("C2", s.AS_OF) and "gst_ratios" in refused.missing
        assert {r.customer_id for r in store.read("ai_reports").collect()} == {"C1"}


def test_requests(spark, folder):
    store = store_with_customers(spark, folder)
    nobody = spark.createDataFrame([], "customer_id string")
    assert reports.run_analytics(store, s.AS_OF, LATER, "none", nobody).count() == 0
    assert store.read("scorecards").count() == 0
    one = spark.createDataFrame([("C2",), ("C2",), ("nobody",)], "customer_id string")
    assert [r.customer_id for r in reports.run_analytics(store, s.AS_OF, LATER, "one", one).collect()] == ["nobody"]
    assert [r.customer_id for r in store.read("scorecards").collect()] == ["C2"]
    rows = spark.range(10).select(F.col("id").cast("string").alias("customer_id"), F.lit(1).alias("x"))
    plan = sc.only_requested([rows], one)[0].groupBy("customer_id").agg(F.sum("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("LeftSemi")


def test_export_keeps_other_dates(spark, folder):
    stored = spark.createDataFrame([(date(2024, 1, 1), "a"), (date(2024, 1, 2), "b")], "scorecard_date date, text string")
    for day in ("2024-01-01", "2024-01-02", "2024-01-02"):
        reports.export_documents(stored.filter(F.col("scorecard_date") == day), "text", f"{folder}/out")
    assert spark.read.text(f"{folder}/out").count() == 2


def test_csv_fields_go_by_the_header_of_their_file(spark, folder):
    data = Path(folder) / "csv"
    data.mkdir()
    names = list(s.epfo())
    one, two = s.epfo(month=1, employee_count=5, employee_churn=1), s.epfo(month=2, employee_count=6, employee_churn=2)
    line = lambda row, order: ",".join(str(row[n]) for n in order)
    (data / "a.csv").write_text("\n".join([",".join(names), line(one, names), "C1,too,short", line(one, names) + ",extra"]))
    (data / "b.csv").write_text("\n".join([",".join(names[::-1]), line(two, names[::-1])]))
    (data / "c.csv").write_text("")
    rows = feeds.read_csv(spark, str(data), FEEDS["epfo_payroll"]).collect()
    assert {(r.month, r.employee_count, r.employee_churn) for r in rows if not r.corrupt} == {("1", "5", "1"), ("2", "6", "2")}
    assert sum(r.corrupt for r in rows) == 2
    store = store_with_customers(spark, folder)
    found = load.load_feed(store, str(data), "epfo_payroll", s.AS_OF, LATER, "run", "csv").collect()
    counts = {paths.name_of(r.source_path): (r.attempted, r.loaded, r.skipped) for r in found}
    assert counts == {"a.csv": (3, 1, 2), "b.csv": (1, 1, 0), "c.csv": (0, 0, 0)}


def test_equal_times_have_one_answer(spark):
    rows = [("C1", date(2024, 1, 1), LATER, "x"), ("C1", date(2024, 1, 2), LATER, "y"), ("C2", date(2024, 1, 1), s.RUN_TS, "z")]
    names = "customer_id string, scorecard_date date, generated_at timestamp, generation_method string"
    for order in (rows, rows[::-1]):
        log = spark.createDataFrame(order, names)
        last = listing.latest_per_customer(log, ["generated_at", "scorecard_date"], "generation_method")
        assert {(r.customer_id, r.generation_method) for r in last.collect()} == {("C1", "y"), ("C2", "z")}
        cards = log.select("customer_id", "scorecard_date", F.lit(1).alias("composite_score"))
        people = log.select("customer_id", F.lit("n").alias("business_name"), F.lit("s").alias("sector")).distinct()
        assert [r.generation_method for r in listing.list_reports(log, people, cards, 2).collect()] == ["x", "y"]
    assert "SortAggregate" not in last._jdf.queryExecution().executedPlan().toString()


def test_stream_of_lines(spark, folder):
    store = store_with_customers(spark, folder)
    arriving = Path(folder) / "arriving"
    arriving.mkdir()
    lines_file(arriving, "one.jsonl", [*s.year(s.epfo), "{"])
    query = stream_feed(store, str(arriving), "epfo_payroll", s.AS_OF, LATER, fmt="jsonl")
    assert query.awaitTermination(120) and query.exception() is None
    assert store.read("epfo_payroll").count() == 12
    (log,) = store.read("data_lineage").filter("table_name = 'epfo_payroll'").collect()
    assert (log.source_file, log.status, log.record_count) == ("one.jsonl", "PARTIAL", 12)
    assert paths.exists(spark, f"{store.root}/_progress")
