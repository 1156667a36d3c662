"""Dimension scores, composite score and flags from the flat ratio columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from altcredit.functions import bands as bd
from altcredit.functions import wording as wd
from altcredit.functions.numeric import dbl, number_text


def _or_zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


# The banded inputs of each dimension and their weights, in summing order.
DIMENSION_PARTS = {
    "aa_bank_cashflow": {"dscr": 0.40, "balance_cover": 0.30, "cheque_returns": 0.20, "cash_withdrawal": 0.10},
    "gst_quality": {"filing_delays": 0.50, "revenue_cv": 0.30, "growth_trend": 0.20},
    "upi_behaviour": {"active_days": 0.50, "ticket_cv": 0.30, "frequency": 0.20},
    "epfo_stability": {"employee_growth": 0.50, "contributions": 0.50},
}
DIMENSIONS = tuple(bd.WEIGHTS)


def band_inputs() -> dict[str, Column]:
    """The value that each band judges.

    A missing bank source counts as zero balance, zero expenses and zero cheque returns; a missing
    payroll source as zero late payments.
    """
    expenses = _or_zero("aa_avg_monthly_operating_expenses")
    cover = F.try_divide(dbl(_or_zero("aa_avg_daily_balance")), bd.expense_days(expenses, 45.0))
    return {
        "dscr": F.col("aa_dscr"),
        # Without expenses any balance covers them.
        "balance_cover": F.when(expenses <= 0, F.lit(float("inf"))).otherwise(cover),
        "cheque_returns": _or_zero("aa_cheque_return_count"),
        "cash_withdrawal": F.col("aa_cash_withdrawal_percent"),
        "filing_delays": F.col("gst_filing_delays"),
        "revenue_cv": F.col("gst_cv_percent"),
        "growth_trend": F.col("gst_cagr_percent"),
        "active_days": F.col("upi_active_days_percent"),
        "ticket_cv": F.col("upi_ticket_size_cv_percent"),
        "frequency": dbl(F.col("upi_total_transactions")) / F.lit(float(bd.DAYS_PER_YEAR)),
        "employee_growth": F.col("epfo_employee_growth_percent"),
        "contributions": _or_zero("epfo_contribution_timeliness_late_count"),
    }


def band_columns() -> list[str]:
    return [f"score_{name}" for parts in DIMENSION_PARTS.values() for name in parts]


def dimension_scores(ratios: DataFrame) -> DataFrame:
    """Adds the twelve band scores and the five dimension scores."""
    banded = ratios.withColumns({f"score_{n}": bd.band(n, value) for n, value in band_inputs().items()})
    dims = {
        name: bd.weighted(*[(F.col(f"score_{part}"), weight) for part, weight in parts.items()])
        for name, parts in DIMENSION_PARTS.items()
    }
    dims["gst_quality"] = F.when(F.col("gst_is_gst_registered"), dims["gst_quality"]).otherwise(
        F.lit(bd.UNREGISTERED_GST_SCORE)
    )
    dims["compliance_bureau"] = F.lit(bd.COMPLIANCE_SCORE)
    return banded.withColumns(dims)


def composite_score(dimensions: DataFrame) -> DataFrame:
    scored = dimensions.withColumn("composite_score", bd.composite())
    return scored.withColumn("score_interpretation", bd.band("score_word", F.col("composite_score")))


def _flag(when: Column, message: str, *args: Column) -> Column:
    return F.when(when, F.format_string(message, *args) if args else F.lit(message))


def flags(ratios: DataFrame) -> DataFrame:
    """Adds ``red_flags`` and ``green_flags``, each in rule order."""
    dscr, cagr = F.col("aa_dscr"), F.col("gst_cagr_percent")
    cheques = _or_zero("aa_cheque_return_count")
    delays = F.col("gst_filing_delays")
    late = _or_zero("epfo_contribution_timeliness_late_count")
    first, last = F.col("epfo_starting_employee_count"), F.col("epfo_ending_employee_count")
    staff_growth = F.col("epfo_employee_growth_percent")
    cash = F.col("aa_cash_withdrawal_percent")
    expenses = F.col("aa_avg_monthly_operating_expenses")
    buffered = (expenses != 0) & (
        dbl(F.col("aa_avg_daily_balance")) > bd.expense_days(expenses, 60.0)
    )
    gst_vs_aa = F.col("cross_gst_vs_aa_ratio")
    red = [
        _flag(dscr < 1.0, wd.WEAK_DSCR_FLAG, number_text(dscr)),
        _flag(cheques >= 2, wd.CHEQUES_FLAG, cheques),
        _flag(delays >= 3, wd.LATE_GST_FLAG, delays),
        _flag(late >= 2, wd.LATE_EPFO_FLAG, late),
        _flag(last < first, wd.FEWER_STAFF_FLAG, first, last),
        _flag(cagr < -5, wd.SALES_DECLINE_FLAG, number_text(cagr)),
        _flag(F.col("cross_gst_vs_aa_mismatch"), wd.CASH_FLOW_FLAG, number_text(gst_vs_aa)),
        _flag(cash > 15, wd.WITHDRAWALS_FLAG, number_text(cash)),
    ]
    green = [
        _flag(dscr > 1.75, wd.STRONG_DSCR_FLAG, number_text(dscr)),
        _flag(cheques == 0, wd.NO_CHEQUES_FLAG),
        _flag(delays == 0, wd.TIMELY_GST_FLAG),
        _flag(staff_growth > 10, wd.MORE_STAFF_FLAG, number_text(staff_growth)),
        _flag(cagr > 5, wd.SALES_GROWTH_FLAG, number_text(cagr)),
        _flag(buffered, wd.BUFFER_FLAG),
    ]
    return ratios.withColumns(
        {
            "red_flags": F.array_compact(F.array(*red)),
            "green_flags": F.array_compact(F.array(*green)),
        }
    )
