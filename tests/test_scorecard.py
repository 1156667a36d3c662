from __future__ import annotations

import itertools

import pytest
from pyspark.sql import functions as F

from altcredit.operators import summaries as sm
from altcredit.operators import validate as vd
from altcredit.operators.registry import FEEDS
from altcredit.plans import scorecard as sc
from tests import samples as s

TABLES = ("gst_filings", "upi_transactions", "bank_statements", "epfo_payroll")


def feed(spark, table, rows):
    spec = FEEDS[table]
    raw = s.raw_frame(spark, rows, [f.raw for f in spec.fields])
    return vd.accepted(vd.check_feed(raw, table, s.AS_OF)).select(*spec.columns)


def cards(spark, gst=(), upi=(), bank=(), epfo=(), ids=("C1",)):
    tables = [feed(spark, t, rows) for t, rows in zip(TABLES, (gst, upi, bank, epfo))]
    customers = spark.createDataFrame([(i,) for i in ids], "customer_id string")
    return sc.scorecards(customers, *tables, s.AS_OF)


def test_known_customer(spark):
    card = cards(
        spark, s.year(s.gst), s.upi_rows(), s.year(s.bank), s.year(s.epfo)
    ).collect()[0]
    gst, aa, epfo, cross = card.gst_ratios, card.aa_ratios, card.epfo_ratios, card.cross_validation
    assert (gst.cagr_percent, gst.mom_growth_percent, gst.cv_percent, gst.filing_delays) == (-1.5, 24.7, 11.0, 5)
    assert (aa.dscr, aa.avg_monthly_credits, aa.avg_daily_balance) == (1.11, 152004, 175742)
    assert (aa.cheque_return_count, aa.cash_withdrawal_percent, aa.cash_conversion_ratio) == (7, 5.0, -0.38)
    assert (epfo.starting_employee_count, epfo.ending_employee_count) == (3, 1)
    assert epfo.contribution_timeliness_late_count == 1
    assert (cross.gst_vs_aa_ratio, cross.aa_payroll_vs_epfo_payroll_ratio) == (0.99, 1.02)
    assert cross.gst_growth_vs_employee_growth == "aligned"
    assert card.red_flags == [
        "Liquidity stress (7 cheque bounces)",
        "Compliance risk (5 late GST filings)",
        "Declining employee count (3 -> 1)",
    ]
    assert card.green_flags == ["Healthy cash buffer (ADB covers 60+ days of expenses)"]
    upi = card.upi_ratios
    assert (upi.total_transactions, upi.active_days, upi.avg_daily_collections) == (362, 4, 3399)
    assert upi.weekend_weekday_ratio == round((5000 / 2) / ((4250 + 4602 + 3141) / 3), 2)


def test_missing_sources(spark):
    """All sixteen combinations of present sources, one customer each."""
    combos = {f"C{i}": present for i, present in enumerate(itertools.product([0, 1], repeat=4))}
    makers = (
        lambda c: s.year(s.gst, c),
        s.upi_rows,
        lambda c: s.year(s.bank, c),
        lambda c: s.year(s.epfo, c),
    )
    feeds = [
        [row for cid, present in combos.items() if present[i] for row in make(cid)]
        for i, make in enumerate(makers)
    ]
    made = cards(spark, *feeds, ids=tuple(combos))
    assert not sc.missing_fields(made) and sc.incomplete(made).isEmpty()
    found = {card.customer_id: card for card in made.collect()}
    assert set(found) == set(combos)
    for cid, (gst, upi, bank, epfo) in combos.items():
        card, dims = found[cid], found[cid].dimension_scores
        assert card.gst_ratios.is_gst_registered == bool(gst)
        assert (card.aa_ratios is None) == (not bank)
        assert (card.epfo_ratios is None) == (not epfo)
        if not gst:
            assert dims.gst_quality == 50 and card.gst_ratios.tax_payment_status == "NA"
        if not upi:
            assert dims.upi_behaviour == 0 and card.upi_ratios.total_transactions == 0
        if not bank:
            assert dims.aa_bank_cashflow == 50 and "Zero cheque bounces" in card.green_flags
        if not epfo:
            assert dims.epfo_stability == 85
        assert (card.cross_validation.gst_vs_aa_ratio is None) == (not (gst and bank))
        assert 0 <= card.composite_score <= 100


def test_positions_ignore_month_gaps_and_single_rows(spark):
    gaps = [s.gst(month=1, gstr_sales=100), s.gst(month=5, gstr_sales=200), s.gst(month=9, gstr_sales=300)]
    card = cards(spark, gst=gaps, bank=[s.bank(month=1)], epfo=[s.epfo(month=1)]).collect()[0]
    assert card.gst_ratios.mom_growth_percent == 50.0 and card.gst_ratios.cagr_percent == 200.0
    assert card.aa_ratios.monthly_credits_trend_slope == 0.0
    assert card.aa_ratios.monthly_credits_volatility_percent == 0.0
    assert card.epfo_ratios.monthly_payroll_variance == 0.0
    one = cards(spark, gst=gaps[:1]).collect()[0].gst_ratios
    assert (one.mom_growth_percent, one.cagr_percent, one.cv_percent) == (None, 0.0, 0.0)


def test_zero_numerator_is_a_mismatch(spark):
    days = [s.upi(collections=0)]
    cross = cards(spark, upi=days, bank=s.year(s.bank)).collect()[0].cross_validation
    assert (cross.upi_vs_aa_credits_ratio, cross.upi_vs_aa_credits_mismatch) == (0.0, True)
    empty = [s.bank(total_credits=0, total_debits=0)]
    cross = cards(spark, upi=[s.upi()], bank=empty).collect()[0].cross_validation
    assert (cross.upi_vs_aa_credits_ratio, cross.upi_vs_aa_credits_mismatch) == (None, None)


def test_side_by_side_sources_equal_separate_tables(spark):
    gst = feed(spark, "gst_filings", [s.gst(month=m) for m in (2, 5, 7)])
    bank = feed(spark, "bank_statements", [s.bank(month=m) for m in (1, 2, 8)])
    epfo = feed(spark, "epfo_payroll", [s.epfo(month=m) for m in (1, 5, 6)])
    keys = ["customer_id", "year", "month"]
    wide = gst.join(bank, keys, "full").join(epfo, keys, "full")
    together = sm.summarize_monthly(wide, [sm.GST, sm.BANK, sm.EPFO])
    apart = sm.summarize_monthly(gst, [sm.GST])
    for rows, source in ((bank, sm.BANK), (epfo, sm.EPFO)):
        apart = apart.join(sm.summarize_monthly(rows, [source]), "customer_id")
    assert together.collect()[0].asDict() == apart.collect()[0].asDict()


def test_partitioning_does_not_change_results(spark):
    rows = [r for cid in ("C1", "C2", "C3") for r in s.year(s.bank, cid)]
    bank = feed(spark, "bank_statements", rows)
    first = {tuple(r) for r in sm.summarize_monthly(bank.repartition(1), [sm.BANK]).collect()}
    second = {
        tuple(r)
        for r in sm.summarize_monthly(bank.repartition(7, F.rand(3)), [sm.BANK]).collect()
    }
    assert first == second


def test_requested_customers(spark):
    customers = spark.createDataFrame([("C1",), ("C2",)], "customer_id string")
    wanted = spark.createDataFrame([("C2",), ("C2",), ("C7",)], "customer_id string")
    chosen, unknown = sc.select_customers(customers, wanted)
    assert [r.customer_id for r in chosen.collect()] == ["C2"]
    assert [r.customer_id for r in unknown.collect()] == ["C7"]
    everyone, unknown = sc.select_customers(customers, None)
    assert everyone.count() == 2 and unknown is None
    nobody, unknown = sc.select_customers(customers, wanted.limit(0))
    assert nobody.count() == 0 and unknown.count() == 0
