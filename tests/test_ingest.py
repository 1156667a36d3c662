from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from altcredit.functions import cleaning as cl
from altcredit.operators import validate as vd
from altcredit.operators.registry import FEEDS
from tests import samples as s


def cleaned(spark, clean, raw):
    value, reason = clean(F.lit(raw).cast("string"), "f")
    row = spark.range(1).select(value, F.when(value.isNull(), reason)).collect()[0]
    return row[0], row[1]


@pytest.mark.parametrize(
    "raw, want",
    [("100", 10000), ("1.005", 100), ("0.125", 12), ("-3.5", -350), (" 7 ", 700), ("1e3", 100000)],
)
def test_paise(spark, raw, want):
    assert cleaned(spark, cl.as_paise, raw) == (want, None)


@pytest.mark.parametrize(
    "clean, raw, reason",
    [
        (cl.as_paise, "abc", "could not convert string to float: 'abc'"),
        (cl.as_paise, "3f", "could not convert string to float: '3f'"),
        (cl.as_paise, "NaN", "cannot convert float NaN to integer"),
        (cl.as_paise, "-Infinity", "cannot convert float infinity to integer"),
        (cl.as_paise, None, "'f'"),
        (cl.as_int, "x", "invalid literal for int() with base 10: 'x'"),
        (cl.as_int, "", "invalid literal for int() with base 10: ''"),
        (cl.as_date, "2024/01/05", "time data '2024/01/05' does not match format '%Y-%m-%d'"),
        (cl.as_date, "2024-13-01", "time data '2024-13-01' does not match format '%Y-%m-%d'"),
        (cl.as_date, "2023-02-29", "day is out of range for month"),
        (cl.as_date, None, "'f'"),
        (cl.as_bool, "maybe", "not a boolean: 'maybe'"),
        (cl.as_bool, None, "'f'"),
        (cl.as_text, None, "'f'"),
    ],
)
def test_unconvertible(spark, clean, raw, reason):
    assert cleaned(spark, clean, raw) == (None, reason)


def test_numbers_and_flags(spark):
    assert cleaned(spark, cl.as_int, "3.7")[0] == 3
    assert cleaned(spark, cl.as_int, " 12 ")[0] == 12
    assert cleaned(spark, cl.as_int, "-1.9")[0] == -1
    assert cleaned(spark, cl.as_bool, "False") == (False, None)
    assert cleaned(spark, cl.as_bool, "true") == (True, None)
    assert str(cleaned(spark, cl.as_date, "2024-1-5")[0]) == "2024-01-05"
    assert cleaned(spark, cl.as_optional, None) == (None, None)


@pytest.mark.parametrize(
    "raw, want",
    [
        ("  Retail ", "Retail"),
        ("FOOD  &\tbeverage", "Food & Beverage"),
        ("o'neil it-services", "O'Neil It-Services"),
        ("3d printing", "3D Printing"),
        ("agro tech", "Agro Tech"),
    ],
)
def test_sector(spark, raw, want):
    assert cleaned(spark, cl.as_sector, raw)[0] == want


def check(spark, table, *rows):
    spec = FEEDS[table]
    raw = s.raw_frame(spark, rows, [f.raw for f in spec.fields])
    return vd.check_feed(raw, table, s.AS_OF)


RULES = [
    ("customers", s.customer(business_name="  "), ["business_name is required"], []),
    ("customers", s.customer(pan=" "), ["pan is required"], []),
    (
        "customers",
        s.customer(gst_number="27abc"),
        [],
        ["gst_number '27ABC' is 5 chars, expected 15 (or 'NOT_REGISTERED' for an NTC customer)"],
    ),
    ("customers", s.customer(gst_number=" not_registered "), [], []),
    (
        "customers",
        s.customer(registration_date="2025-01-02", pan="", gst_number="x"),
        ["pan is required", "registration_date '2025-01-02' is in the future"],
        ["gst_number 'X' is 1 chars, expected 15 (or 'NOT_REGISTERED' for an NTC customer)"],
    ),
    ("customers", s.customer(registration_date="2025-01-01"), [], []),
    ("gst_filings", s.gst(month=13, filing_date="2024-01-01"), ["month 13 out of range 1-12"], []),
    ("gst_filings", s.gst(gstr_sales=0), ["gstr_sales must be > 0 for a GST-registered customer"], []),
    ("gst_filings", s.gst(tax_paid=-1), ["tax_paid cannot be negative"], []),
    ("gst_filings", s.gst(filing_date="2026-02-01"), ["filing_date '2026-02-01' is in the future"], []),
    ("gst_filings", s.gst(year=1999), ["violates constraint: year between 2000 and 2100"], []),
    ("gst_filings", s.gst(is_delayed=None), ["transform failed: 'is_delayed'"], []),
    ("upi_transactions", s.upi(collections=-1), ["collections cannot be negative"], []),
    ("upi_transactions", s.upi(num_transactions=0), ["num_transactions must be > 0"], []),
    ("upi_transactions", s.upi(day="2025-06-01"), ["txn_date '2025-06-01' is in the future"], []),
    ("bank_statements", s.bank(month=1, dscr=0), ["dscr 0.0 must be > 0"], None),
    ("bank_statements", s.bank(total_credits=-5, total_debits=-6), ["credits/debits cannot be negative"], []),
    (
        "bank_statements",
        s.bank(total_credits=10, total_debits=11),
        [],
        ["total_debits (1100) exceeds total_credits (1000) - cash flow anomaly"],
    ),
    ("bank_statements", s.bank(cash_withdrawals=-1), ["violates constraint: cash_withdrawals_paise >= 0"], None),
    ("epfo_payroll", s.epfo(employee_count=0), ["employee_count must be > 0"], []),
    ("epfo_payroll", s.epfo(monthly_payroll=-1), ["monthly_payroll cannot be negative"], []),
    ("epfo_payroll", s.epfo(contribution_date="2025-01-02"), ["contribution_date '2025-01-02' is in the future"], []),
]


@pytest.mark.parametrize("table, row, blocking, warnings", RULES)
def test_rules(spark, table, row, blocking, warnings):
    got = check(spark, table, row).collect()[0]
    assert got.blocking == blocking
    if warnings is not None:
        assert got.warnings == warnings


def test_record_ids(spark):
    assert check(spark, "customers", s.customer()).collect()[0].record_id == "C1"
    assert check(spark, "gst_filings", s.gst(month=3)).collect()[0].record_id == "C1:2024-03"
    assert check(spark, "upi_transactions", s.upi()).collect()[0].record_id == "C1:2024-01-01"
    failed = check(spark, "epfo_payroll", s.epfo(cid=None), {**s.epfo(), "month": "x"})
    assert sorted(r.record_id for r in failed.collect()) == ["C1", "UNKNOWN"]


def test_error_rows_list_warnings_first(spark):
    checked = check(spark, "customers", s.customer(gst_number="x", pan=""))
    rows = vd.error_rows(checked, "customers", F.lit("customers.json")).orderBy("position").collect()
    assert [r.error_reason.split(" ")[0] for r in rows] == ["gst_number", "pan"]
    issues = [r.issue for r in vd.dry_run_issues(checked, "customers").collect()]
    assert issues[0] == "C1: pan is required" and issues[1].endswith("(warning)")


def test_status(spark):
    counts = spark.createDataFrame([(0, 0, 0), (2, 2, 0), (2, 1, 1), (2, 0, 2)], "attempted long, loaded long, skipped long")
    rows = vd.load_status(counts).collect()
    assert [r.status for r in rows] == ["SUCCESS", "SUCCESS", "PARTIAL", "FAILED"]
    assert [r.error_message for r in rows] == [None, None, "1 record(s) failed validation", "2 record(s) failed validation"]


def test_orphans_and_duplicates(spark):
    customers = spark.createDataFrame([("C1",)], "customer_id string")
    checked = check(spark, "gst_filings", s.gst(), s.gst(cid="C9"), s.gst(cid="C9", month=2), s.gst())
    flagged = {r.record_id: r.blocking for r in vd.block_orphans(checked, customers).collect()}
    assert flagged["C9:2024-01"] == [vd.ORPHAN] and flagged["C1:2024-01"] == []
    assert [tuple(r) for r in vd.orphans(checked, customers).collect()] == [("C9", 2)]
    twice = vd.duplicate_keys(checked, FEEDS["gst_filings"].keys).collect()
    assert [tuple(r) for r in twice] == [("C1", 2024, 1, 2)]
