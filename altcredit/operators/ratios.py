"""Ratios per source as projections over the per-customer sums.

Columns are flat (``gst_cagr_percent``) while they are being computed and packed into structs
only in the final document: packing early would make the optimizer inline each ratio into every
rule that reads it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from altcredit.functions import numeric as nm
from altcredit.functions.bands import DAYS_PER_YEAR

NA = "NA"
DAYS_PER_MONTH = 30
MONTHS_PER_YEAR = 12


def _present(n: str) -> Column:
    return F.coalesce(F.col(n) > 0, F.lit(False))


def gst_ratios(sums: DataFrame) -> DataFrame:
    n = F.col("gst_n")
    registered = _present("gst_n")
    cv = nm.coefficient_of_variation(n, F.col("gst_sum"), F.col("gst_sq"))
    growth = nm.cagr(F.col("gst_first"), F.col("gst_last"))
    month_growth = nm.change(F.col("gst_previous"), F.col("gst_last"))
    return sums.withColumns(
        {
            "gst_is_gst_registered": registered,
            "gst_cagr_percent": nm.percent(growth),
            "gst_mom_growth_percent": nm.percent(month_growth),
            "gst_cv_percent": nm.percent(cv),
            "gst_filing_delays": F.when(registered, F.col("gst_delays")),
            "gst_tax_payment_status": F.lit(NA),
            "gst_itc_utilization_percent": F.lit(NA),
            "gst_customer_concentration": F.lit(NA),
        }
    )


def weekend_weekday_ratio() -> Column:
    weekend = nm.mean_rupees(F.col("upi_weekend"), F.col("upi_weekend_n"))
    weekday = nm.mean_rupees(
        F.col("upi_collections") - F.col("upi_weekend"), F.col("upi_n") - F.col("upi_weekend_n")
    )
    return nm.rnd(nm.ratio(weekend, weekday), 2)


def upi_ratios(sums: DataFrame) -> DataFrame:
    n = F.col("upi_n")

    def or_zero(x: Column) -> Column:
        return F.coalesce(x, F.lit(0).cast("long"))

    active = or_zero(F.col("upi_active"))
    ticket_cv = nm.coefficient_of_variation(n, F.col("upi_tickets"), F.col("upi_tickets_sq"))
    mean_collections = nm.mean_rupees(F.col("upi_collections"), n)
    mean_ticket = nm.mean_rupees(F.col("upi_tickets"), n)
    return sums.withColumns(
        {
            "upi_avg_daily_collections": or_zero(nm.rnd_long(mean_collections)),
            "upi_total_transactions": or_zero(F.col("upi_transactions")),
            "upi_avg_ticket_size": or_zero(nm.rnd_long(mean_ticket)),
            "upi_active_days": active,
            "upi_active_days_percent": nm.percent(nm.dbl(active) / F.lit(float(DAYS_PER_YEAR))),
            "upi_ticket_size_cv_percent": nm.percent(ticket_cv),
            "upi_repeat_customer_rate": F.lit(NA),
            "upi_weekend_weekday_ratio": weekend_weekday_ratio(),
        }
    )


def credit_slope() -> Column:
    """Rupees per month."""
    paise = nm.slope(F.col("bank_n"), F.col("bank_credits"), F.col("bank_credits_indexed"))
    return nm.rnd(paise / F.lit(100.0), 2)


def aa_ratios(sums: DataFrame) -> DataFrame:
    n = F.col("bank_n")
    present = _present("bank_n")

    def mean(total: str) -> Column:
        return nm.mean_rupees(F.col(total), n)

    def whole(x: Column) -> Column:
        return nm.rnd_long(x)

    cv = nm.coefficient_of_variation(n, F.col("bank_credits"), F.col("bank_credits_sq"))
    credits = mean("bank_credits")
    return sums.withColumns(
        {
            "aa_available": present,
            "aa_avg_monthly_credits": whole(credits),
            "aa_monthly_credits_trend_slope": F.when(present, credit_slope()),
            "aa_monthly_credits_volatility_percent": nm.percent(cv),
            "aa_avg_daily_balance": whole(mean("bank_balance")),
            "aa_avg_monthly_operating_expenses": whole(mean("bank_opex")),
            "aa_cash_conversion_ratio": nm.rnd(nm.ratio(mean("bank_surplus"), credits), 2),
            "aa_dscr": nm.rnd(nm.mean_rupees(F.col("bank_dscr_hundredths"), n), 2),
            "aa_existing_debt_total_annual": F.when(
                present, whole(nm.dbl(F.col("bank_emi")) / F.lit(100.0))
            ),
            "aa_existing_debt_avg_monthly": whole(mean("bank_emi")),
            "aa_existing_debt_instrument_count": F.when(present, F.lit(NA)),
            "aa_cheque_return_count": F.when(present, F.col("bank_cheques")),
            "aa_cash_withdrawal_percent": nm.percent(nm.ratio(mean("bank_cash"), credits)),
            "aa_days_sales_outstanding": F.when(present, F.lit(NA)),
        }
    )


def epfo_ratios(sums: DataFrame) -> DataFrame:
    n = F.col("epfo_n")
    present = _present("epfo_n")
    first, last = F.col("epfo_first_headcount"), F.col("epfo_last_headcount")
    headcount = nm.ratio(F.col("epfo_headcount"), n)
    payroll_std = nm.sample_std(n, F.col("epfo_payroll"), F.col("epfo_payroll_sq"))
    headcount_slope = nm.slope(n, F.col("epfo_headcount"), F.col("epfo_headcount_indexed"))
    wage_change = nm.change(F.col("epfo_first_wage"), F.col("epfo_last_wage"))
    churn = nm.ratio(F.col("epfo_churn"), F.lit(float(MONTHS_PER_YEAR)) * headcount)
    return sums.withColumns(
        {
            "epfo_available": present,
            "epfo_starting_employee_count": first,
            "epfo_ending_employee_count": last,
            "epfo_employee_growth_percent": nm.percent(nm.change(first, last)),
            "epfo_avg_employee_count": nm.rnd(headcount, 1),
            "epfo_employee_count_trend_slope": F.when(present, nm.rnd(headcount_slope, 3)),
            "epfo_avg_monthly_payroll": nm.rnd_long(nm.mean_rupees(F.col("epfo_payroll"), n)),
            "epfo_monthly_payroll_variance": nm.rnd(payroll_std / F.lit(100.0), 2),
            "epfo_avg_wage": nm.rnd_long(nm.mean_rupees(F.col("epfo_wage"), n)),
            "epfo_wage_inflation_percent": nm.percent(wage_change),
            "epfo_contribution_timeliness_late_count": F.when(present, F.col("epfo_late")),
            "epfo_employee_churn_rate": nm.rnd(churn, 4),
        }
    )


# Reconciled pairs: output prefix -> (numerator, denominator) among the source means.
CROSS_PAIRS = {
    "gst_vs_aa": ("_gst_sales", "_aa_credits"),
    "gst_vs_upi": ("_gst_sales", "_upi_monthly"),
    "aa_payroll_vs_epfo_payroll": ("_aa_payroll", "_epfo_payroll"),
    "upi_vs_aa_credits": ("_upi_monthly", "_aa_credits"),
}
# A reconciled ratio outside these limits is a mismatch.
MISMATCH_ABOVE = 1.5
MISMATCH_BELOW = 0.5


def growth_alignment() -> Column:
    """Whether sales and headcount moved the same way, from unrounded growth."""
    sales = F.when(F.col("gst_n") >= 2, nm.cagr(F.col("gst_first"), F.col("gst_last")))
    staff = nm.change(F.col("epfo_first_headcount"), F.col("epfo_last_headcount"))
    return (
        F.when(sales.isNull() | staff.isNull(), F.lit(NA))
        .when((sales >= 0) == (staff >= 0), F.lit("aligned"))
        .otherwise(F.lit("misaligned"))
    )


def cross_validation(sums: DataFrame) -> DataFrame:
    """Reconciles the sources with each other; a zero numerator is data, not absence."""
    means = sums.withColumns(
        {
            "_gst_sales": nm.mean_rupees(F.col("gst_sum"), F.col("gst_n")),
            "_aa_credits": nm.mean_rupees(F.col("bank_credits"), F.col("bank_n")),
            "_upi_monthly": nm.mean_rupees(F.col("upi_collections"), F.col("upi_n"))
            * F.lit(float(DAYS_PER_MONTH)),
            "_aa_payroll": nm.mean_rupees(F.col("bank_payroll"), F.col("bank_n")),
            "_epfo_payroll": nm.mean_rupees(F.col("epfo_payroll"), F.col("epfo_n")),
        }
    )
    ratios = means.withColumns(
        {
            f"cross_{name}_ratio": nm.rnd(nm.ratio(F.col(above), F.col(below)), 2)
            for name, (above, below) in CROSS_PAIRS.items()
        }
    )
    flags = {}
    for name in CROSS_PAIRS:
        value = F.col(f"cross_{name}_ratio")
        flags[f"cross_{name}_mismatch"] = (value > MISMATCH_ABOVE) | (value < MISMATCH_BELOW)
    flags["cross_gst_growth_vs_employee_growth"] = growth_alignment()
    return ratios.withColumns(flags)
