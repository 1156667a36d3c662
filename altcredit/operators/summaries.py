"""Per-customer sums of the four sources: the only place where feed rows are aggregated.

Everything later (ratios, cross-validation, scores, facts) is a projection over these sums, so
each source is scanned once and shuffled once on the customer.

Monthly tables hold one row per (customer, year, month) and years 2000..2100, which bounds the
window below at 1212 rows per customer whatever the data volume; daily UPI rows are only ever
aggregated with partial (map-side) aggregates. Several monthly sources may sit side by side in
one frame: rows where a source has no value are ignored for that source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from altcredit.functions.numeric import square

KEYS = ("customer_id",)
WEEKEND = ("Saturday", "Sunday")

GST = "gst"
BANK = "bank"
EPFO = "epfo"


def _period(value: str) -> Column:
    """Ordering key of the rows that have ``value``."""
    return F.when(F.col(value).isNotNull(), F.col("year") * F.lit(12) + F.col("month"))


def _first(value: str, marker: str | None = None) -> Column:
    return F.min_by(value, _period(marker or value))


def _last(value: str, marker: str | None = None) -> Column:
    return F.max_by(value, _period(marker or value))


def _position(value: str, ordered: WindowSpec) -> Column:
    """0-based row number among the rows that have ``value``."""
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.count(value).over(upto) - F.lit(1)


def _gst_order_columns(ordered: WindowSpec) -> dict[str, Column]:
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    return {"_previous_sales": F.last("gstr_sales_paise", ignorenulls=True).over(before)}


def _gst_sums() -> list[Column]:
    sales = F.col("gstr_sales_paise")
    return [
        F.count(sales).alias("gst_n"),
        F.sum(sales).alias("gst_sum"),
        F.sum(square(sales)).alias("gst_sq"),
        F.min(sales).alias("gst_min_paise"),
        F.max(sales).alias("gst_max_paise"),
        _first("gstr_sales_paise").alias("gst_first"),
        _last("gstr_sales_paise").alias("gst_last"),
        _last("_previous_sales", "gstr_sales_paise").alias("gst_previous"),
        F.count_if(F.col("is_delayed")).alias("gst_delays"),
    ]


def _bank_order_columns(ordered: WindowSpec) -> dict[str, Column]:
    return {"_credit_position": _position("total_credits_paise", ordered)}


def _bank_sums() -> list[Column]:
    credits = F.col("total_credits_paise")
    dscr_hundredths = F.rint(F.col("dscr").cast("double") * F.lit(100)).cast("long")
    return [
        F.count(credits).alias("bank_n"),
        F.sum(credits).alias("bank_credits"),
        F.sum(square(credits)).alias("bank_credits_sq"),
        F.sum(F.col("_credit_position") * credits).alias("bank_credits_indexed"),
        F.sum("operating_surplus_paise").alias("bank_surplus"),
        F.sum("avg_daily_balance_paise").alias("bank_balance"),
        F.sum("operating_expenses_paise").alias("bank_opex"),
        F.sum("payroll_paid_paise").alias("bank_payroll"),
        F.sum("existing_emi_paise").alias("bank_emi"),
        F.sum("cash_withdrawals_paise").alias("bank_cash"),
        F.sum("cheque_returns").alias("bank_cheques"),
        F.sum(dscr_hundredths).alias("bank_dscr_hundredths"),
    ]


def _epfo_order_columns(ordered: WindowSpec) -> dict[str, Column]:
    return {"_headcount_position": _position("employee_count", ordered)}


def _epfo_sums() -> list[Column]:
    headcount = F.col("employee_count").cast("long")
    payroll = F.col("monthly_payroll_paise")
    return [
        F.count(headcount).alias("epfo_n"),
        F.sum(headcount).alias("epfo_headcount"),
        F.sum(F.col("_headcount_position") * headcount).alias("epfo_headcount_indexed"),
        _first("employee_count").alias("epfo_first_headcount"),
        _last("employee_count").alias("epfo_last_headcount"),
        F.sum(payroll).alias("epfo_payroll"),
        F.sum(square(payroll)).alias("epfo_payroll_sq"),
        F.sum("avg_wage_paise").alias("epfo_wage"),
        _first("avg_wage_paise").alias("epfo_first_wage"),
        _last("avg_wage_paise").alias("epfo_last_wage"),
        F.count_if(F.col("is_late_contribution")).alias("epfo_late"),
        F.sum("employee_churn").alias("epfo_churn"),
    ]


_MONTHLY = {
    GST: (_gst_order_columns, _gst_sums),
    BANK: (_bank_order_columns, _bank_sums),
    EPFO: (_epfo_order_columns, _epfo_sums),
}


def summarize_monthly(
    rows: DataFrame, sources: Sequence[str], keys: Sequence[str] = KEYS
) -> DataFrame:
    """Sums of one or more monthly sources held in ``rows``, one row per key.

    One shuffle: the window and the aggregation both partition on ``keys``.
    """
    ordered = Window.partitionBy(*keys).orderBy("year", "month")
    positions: dict[str, Column] = {}
    sums: list[Column] = []
    for source in sources:
        order_columns, aggregates = _MONTHLY[source]
        positions |= order_columns(ordered)
        sums += aggregates()
    return rows.select("*", *[c.alias(n) for n, c in positions.items()]).groupBy(*keys).agg(*sums)


def summarize_upi(rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Sums of the daily UPI rows, one row per key."""
    collections, tickets = F.col("collections_paise"), F.col("avg_ticket_size_paise")
    weekend = F.col("day_of_week").isin(*WEEKEND)
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("upi_n"),
        F.sum(collections).alias("upi_collections"),
        F.sum(F.col("num_transactions").cast("long")).alias("upi_transactions"),
        F.sum(tickets).alias("upi_tickets"),
        F.sum(square(tickets)).alias("upi_tickets_sq"),
        F.count_if(collections > 0).alias("upi_active"),
        F.count_if(weekend).alias("upi_weekend_n"),
        F.coalesce(F.sum(F.when(weekend, collections)), F.lit(0)).alias("upi_weekend"),
    )
