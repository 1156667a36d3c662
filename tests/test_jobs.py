"""Whole jobs over files and a store in a fresh folder."""

from __future__ import annotations

import json
from datetime import date, datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from altcredit.operators import listing
from altcredit.plans import load, reports
from altcredit.sources import feeds, paths
from altcredit.sources.store import TableStore
from altcredit.operators.registry import FEEDS
from altcredit.streaming.feeds import stream_feed
from tests import samples as s

LATER = s.RUN_TS + timedelta(days=1)


def write_all(folder):
    data = Path(folder) / "data"
    data.mkdir(exist_ok=True)
    people = [s.customer("C1"), s.customer("C2", gst_number="not_registered"), s.customer("C3", pan="")]
    s.write_feed(data, "customers", people)
    s.write_feed(data, "gst_filings", s.year(s.gst) + [s.gst("C9")])
    s.write_feed(data, "upi_transactions", s.upi_rows("C1") + s.upi_rows("C2"))
    s.write_feed(data, "bank_statements", s.year(s.bank) + [s.bank("C2", dscr="x")])
    s.write_feed(data, "epfo_payroll", s.year(s.epfo))
    return str(data)


def loaded(spark, folder, run_id="run1", run_ts=s.RUN_TS):
    store = TableStore(spark, f"{folder}/store")
    results = load.run_etl(store, write_all(folder), s.AS_OF, run_ts, run_id)
    return store, [r.collect()[0] for r in results]


def test_full_run_and_repeat(spark, folder):
    store, results = loaded(spark, folder)
    assert [(r.table_name, r.attempted, r.loaded, r.skipped) for r in results] == [
        ("customers", 3, 2, 1),
        ("gst_filings", 13, 12, 1),
        ("upi_transactions", 10, 10, 0),
        ("bank_statements", 13, 12, 1),
        ("epfo_payroll", 12, 12, 0),
    ]
    lineage = {r.table_name: (r.source_file, r.status, r.record_count, r.error_message) for r in store.read("data_lineage").collect()}
    assert lineage["customers"] == ("customers.json", "PARTIAL", 2, "1 record(s) failed validation")
    assert lineage["epfo_payroll"] == ("epfo_payroll.json", "SUCCESS", 12, None)
    errors = {(r.record_identifier, r.error_reason) for r in store.read("validation_errors").collect()}
    assert ("C3", "pan is required") in errors
    assert ("C9:2024-01", "violates constraint: customer_id references customers") in errors
    assert ("C2", "transform failed: could not convert string to float: 'x'") in errors

    before = {t: store.read(t).count() for t in FEEDS}
    load.run_etl(store, f"{folder}/data", s.AS_OF, LATER, "run2")
    assert {t: store.read(t).count() for t in FEEDS} == before
    row = store.read("gst_filings").filter("month = 3").collect()[0]
    assert row.created_at == s.RUN_TS and row.updated_at == LATER
    assert store.read("data_lineage").count() == 10
    load.load_feed(store, f"{folder}/data/customers.json", "customers", s.AS_OF, LATER, "run2")
    assert store.read("data_lineage").count() == 10  # a repeated run does not double its log


def test_last_record_wins_and_other_periods_stay(spark, folder):
    store, _ = loaded(spark, folder)
    again = [s.gst(month=2, gstr_sales=1), s.gst(month=2, gstr_sales=2), {**s.gst(month=2), "year": 2023}]
    path = s.write_feed(folder, "gst_filings", again)
    load.load_feed(store, path, "gst_filings", s.AS_OF, LATER, "run2")
    rows = {(r.year, r.month): r for r in store.read("gst_filings").collect()}
    assert len(rows) == 13
    assert rows[2024, 2].gstr_sales_paise == 200 and rows[2024, 2].updated_at == LATER
    assert rows[2023, 2].created_at == LATER
    assert rows[2024, 3].updated_at == s.RUN_TS


def test_unreadable_missing_and_empty_files(spark, folder):
    store, _ = loaded(spark, folder)
    many = Path(folder) / "many files"
    many.mkdir()
    (many / "a.json").write_text(json.dumps(s.year(s.epfo)[:2]))
    (many / "b.json").write_text('[{"customer_id": "C1", "month": 3')
    (many / "c.json").write_text("[]")
    result = load.load_feed(store, str(many), "epfo_payroll", s.AS_OF, LATER, "run2")
    counts = {paths.name_of(r.source_path): (r.attempted, r.loaded, r.skipped) for r in result.collect()}
    assert counts == {"a.json": (2, 2, 0), "b.json": (0, 0, 0), "c.json": (0, 0, 0)}
    load.load_feed(store, f"{folder}/none.json", "epfo_payroll", s.AS_OF, LATER, "run3")
    new = store.read("data_lineage").filter(F.col("load_timestamp") == F.lit(LATER)).collect()
    status = {paths.name_of(r.source_file): (r.status, r.record_count) for r in new}
    assert status == {"a.json": ("SUCCESS", 2), "b.json": ("FAILED", 0), "c.json": ("SUCCESS", 0), "none.json": ("FAILED", 0)}
    failed = [r.source_file for r in new if r.status == "FAILED"]
    assert all("/" in f for f in failed)
    with pytest.raises(ValueError, match="Unknown table_name"):
        load.load_feed(store, "x", "nope", s.AS_OF, LATER, "run4")


def test_other_formats(spark, folder):
    spec = FEEDS["epfo_payroll"]
    lines = Path(folder) / "lines.jsonl"
    lines.write_text("\n".join(json.dumps(r) for r in s.year(s.epfo)))
    names = list(s.epfo())
    table = Path(folder) / "table.csv"
    table.write_text("\n".join([",".join(names)] + [",".join(str(r[n]) for n in names) for r in s.year(s.epfo)]))
    array = s.write_feed(folder, "epfo_payroll", s.year(s.epfo))
    fields = [f.raw for f in spec.fields if f.raw != "is_late_contribution"]

    def content(path, fmt):
        rows = feeds.read_feed(spark, str(path), spec, fmt).orderBy(*feeds.ORDER).select(*fields)
        return [tuple(r) for r in rows.collect()]

    assert content(array, "json") == content(lines, "jsonl") == content(table, "csv")
    with pytest.raises(ValueError):
        feeds.read_feed(spark, array, spec, "xml")


def test_dry_run(spark, folder):
    data = write_all(folder)
    (Path(data) / "upi_transactions.json").write_text("{[")
    (Path(data) / "epfo_payroll.json").rename(Path(data) / "elsewhere.json")
    issues = {(r.table_name, r.issue) for r in load.validate_data(spark, data, s.AS_OF).collect()}
    assert ("customers", "C3: pan is required") in issues
    assert ("upi_transactions", "upi_transactions.json: failed to read/parse: not a JSON array of records") in issues
    assert ("epfo_payroll", "epfo_payroll.json not found") in issues
    assert any(i.endswith("cash flow anomaly (warning)") for _, i in issues)


def test_scorecards_and_reports(spark, folder):
    store, _ = loaded(spark, folder)
    for day in (date(2024, 12, 1), s.AS_OF):
        assert reports.run_analytics(store, day, s.RUN_TS, f"score-{day}") is None
    assert store.read("scorecards").count() == 4
    one = spark.createDataFrame([("C1",), ("nobody",)], "customer_id string")
    unknown = reports.run_analytics(store, s.AS_OF, LATER, "score-again", one)
    assert [r.customer_id for r in unknown.collect()] == ["nobody"]
    assert store.read("scorecards").count() == 4

    stored = {(r.customer_id, r.scorecard_date): r for r in store.read("scorecards").collect()}
    card = json.loads(stored["C2", s.AS_OF].scorecard_json)
    assert card["aa_ratios"] == {} and card["gst_ratios"]["cagr_percent"] is None
    assert card["scorecard_date"] == "2025-01-01"
    assert card["composite_score"] == stored["C2", s.AS_OF].composite_score

    newest = {r.customer_id: r for r in reports.latest_scorecards(store).collect()}
    assert {r.scorecard_date for r in newest.values()} == {s.AS_OF}

    reports.generate_reports(store, LATER, "report1")
    rows = {r.customer_id: json.loads(r.report_json) for r in store.read("ai_reports").collect()}
    assert set(rows) == {"C1", "C2"}
    one, two = rows["C1"], rows["C2"]
    assert [c["type"] for c in one["chart_configs"]] == ["gauge", "bar", "table", "line", "line"]
    assert one["chart_configs"][3]["data"][0] == {"month": "Jan 2024", "value": 172038}
    assert one["chart_configs"][4]["data"][-1] == {"month": "Dec 2024", "value": 1}
    assert one["audit_trail"]["data_sources_used"] == ["GST", "UPI", "AA", "EPFO"]
    assert one["audit_trail"]["ratios_cited"] == 16
    assert one["audit_trail"]["total_claims"] == 3 + len(one["narrative"]["strengths"]) + len(one["narrative"]["risks"])
    assert one["narrative"]["summary"].startswith("Shop One (Food & Beverage) has a composite")
    assert "DSCR is 1.11, indicating modest, borderline" in one["narrative"]["financial_health"]
    assert two["chart_configs"][2]["rows"][0] == ["GST vs Bank Credits", "NA", "NA"]
    assert two["chart_configs"][3]["title"].startswith("UPI Monthly")
    assert two["chart_configs"][3]["data"] == [{"month": "Jan 2024", "value": 13852}, {"month": "Feb 2024", "value": 3141}]
    assert two["audit_trail"]["data_sources_used"] == ["UPI"]
    assert "not available for this customer" in two["narrative"]["financial_health"]

    listed = listing.list_reports(store.read("ai_reports"), store.read("customers"), store.read("scorecards"), 1)
    assert [r.customer_id for r in listed.collect()] == ["C1"]
    pair = listing.find_reports(store.read("ai_reports"), store.read("scorecards")).filter("customer_id = 'C1'")
    assert pair.count() == 1

    reports.export_documents(store.read("ai_reports"), "report_json", f"{folder}/export")
    lines = spark.read.text(f"{folder}/export/scorecard_date=2025-01-01").collect()
    assert {json.loads(r.value)["customer_id"] for r in lines} == {"C1", "C2"}


def test_interrupted_merge_is_completed_from_its_copy(spark, folder):
    store = TableStore(spark, f"{folder}/store")
    store.create_tables()
    scores = "customer_id string, scorecard_date date, scorecard_json string, composite_score int"
    first = spark.createDataFrame([("C1", s.AS_OF, "{}", 50), ("C2", s.AS_OF, "{}", 60)], scores)
    store.upsert(first, "scorecards", s.RUN_TS)
    second = spark.createDataFrame([("C1", s.AS_OF, "{}", 70)], scores)
    staged = store.staged_path("scorecards")
    store._merged(second, "scorecards", LATER).write.parquet(staged)
    # The run died after half of the old partition had been removed.
    one = store.read("scorecards").filter("customer_id = 'C1'").collect()
    spark.createDataFrame(one, store.read("scorecards").schema).write.option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("scorecard_date").mode("overwrite").parquet(store.path("scorecards"))
    store.upsert(second, "scorecards", LATER)
    rows = {r.customer_id: (r.composite_score, r.created_at) for r in store.read("scorecards").collect()}
    assert rows == {"C1": (70, s.RUN_TS), "C2": (60, s.RUN_TS)}
    assert not paths.exists(spark, staged)


def test_create_tables_keeps_data(spark, folder):
    store, _ = loaded(spark, folder)
    count = store.read("gst_filings").count()
    store.create_tables()
    assert store.read("gst_filings").count() == count
    ordered = listing.customer_rows(store.read("gst_filings"), "gst_filings", "C1").collect()
    assert [r.month for r in ordered] == list(range(1, 13))
    with pytest.raises(ValueError, match="Unknown table_name"):
        store.path("nope")


def test_customer_financials(spark, folder):
    store, _ = loaded(spark, folder)
    tables = {t: store.read(t) for t in listing.CHILD_ORDER}
    docs = {r.customer_id: r for r in listing.customer_financials(store.read("customers"), tables).collect()}
    assert [x.month for x in docs["C1"].gst_filings] == list(range(1, 13))
    assert docs["C2"].gst_filings == [] and len(docs["C2"].upi_transactions) == 5
    counts = {r.customer_id: r for r in listing.row_counts(store.read("customers"), tables).collect()}
    assert counts["C2"].gst_filings_rows == 0 and counts["C1"].epfo_payroll_rows == 12


def test_stream_loads_only_new_files(spark, folder):
    store, _ = loaded(spark, folder)
    arriving = Path(folder) / "arriving"
    arriving.mkdir()
    (arriving / "one.json").write_text(json.dumps([{**r, "year": 2023} for r in s.year(s.gst)]))

    def run():
        query = stream_feed(store, str(arriving), "gst_filings", s.AS_OF, LATER)
        assert query.awaitTermination(120)
        assert query.exception() is None

    run()
    assert store.read("gst_filings").count() == 24
    (arriving / "two.json").write_text(json.dumps([{**s.gst(month=1, gstr_sales=7), "year": 2023}, {**s.gst(), "year": 2022}]))
    run()
    run()
    rows = {(r.year, r.month): r.gstr_sales_paise for r in store.read("gst_filings").collect()}
    assert len(rows) == 25 and rows[2023, 1] == 700
    files = [r.source_file for r in store.read("data_lineage").collect()]
    assert files.count("one.json") == 1 and files.count("two.json") == 1
