"""Lookups and listings over stored customers, scorecards and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHILD_ORDER = {
    "gst_filings": ("year", "month"),
    "upi_transactions": ("txn_date",),
    "bank_statements": ("year", "month"),
    "epfo_payroll": ("year", "month"),
}
#: Dates lie within so many days of 1970.
_DAYS = 4_000_000
CUSTOMER_COLUMNS = ("customer_id", "business_name", "sector", "persona", "gst_number")


def customer_rows(table: DataFrame, name: str, customer_id: str) -> DataFrame:
    """One customer's rows of a source table in period order."""
    return table.filter(F.col("customer_id") == customer_id).orderBy(*CHILD_ORDER[name])


def customer_ids(customers: DataFrame) -> DataFrame:
    return customers.select("customer_id").orderBy("customer_id")


def customer_listing(customers: DataFrame) -> DataFrame:
    return customers.select(*CUSTOMER_COLUMNS).orderBy("customer_id")


def lookup_customers(requested: DataFrame, customers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Name, sector and GST number of the requested ids, and the ids that are unknown.

    Requests are reduced to distinct ids first, so a much-requested id costs one row.
    """
    ids = requested.select("customer_id").distinct()
    known = customers.select("customer_id", "business_name", "sector", "gst_number")
    return (
        ids.join(known, "customer_id"),
        ids.join(known.select("customer_id"), "customer_id", "left_anti"),
    )


def latest_per_customer(stored: DataFrame, newest: Sequence[str], *values: str) -> DataFrame:
    """The last row per customer in the order of the ``newest`` columns.

    One maximum after the other, each a hash aggregation over narrow rows that is joined back on the
    customer: documents are never sorted, and one that is not the newest is dropped by the first join.
    """
    rows = stored.select("customer_id", *newest, *values)
    for name in newest:
        top = rows.groupBy("customer_id").agg(F.max(name).alias(name))
        rows = rows.join(top, ["customer_id", name])
    return rows.select("customer_id", *newest, *values)


def list_reports(
    reports: DataFrame, customers: DataFrame, cards: DataFrame, limit: int | None = None
) -> DataFrame:
    """Reports with customer names and scores, newest first; equal times by customer and date.

    With a limit the newest reports that have a customer and a scorecard are chosen first, and only
    those are joined to their names.
    """
    names = customers.select("customer_id", "business_name", "sector")
    scores = cards.select("customer_id", "scorecard_date", "composite_score")
    order = (F.desc("generated_at"), "customer_id", "scorecard_date")
    chosen = reports.select("customer_id", "scorecard_date", "generation_method", "generated_at")
    # A report has one scorecard, so the join that tells whether there is one brings its score too.
    chosen = chosen.join(scores, ["customer_id", "scorecard_date"])
    if limit is not None:
        chosen = chosen.join(names, "customer_id", "left_semi").orderBy(*order).limit(limit)
    return (
        chosen.join(names, "customer_id")
        .select(
            "customer_id",
            "business_name",
            "sector",
            "scorecard_date",
            "composite_score",
            "generation_method",
            "generated_at",
        )
        .orderBy(*order)
    )


def labelled(listed: DataFrame) -> DataFrame:
    """The report table as it is shown to a reader."""
    return listed.select(
        F.concat_ws(" -- ", "customer_id", "business_name").alias("customer"),
        "sector",
        F.col("scorecard_date").alias("date"),
        "composite_score",
        F.col("generation_method").alias("source"),
        "generated_at",
    )


def newest_reports(reports: DataFrame) -> DataFrame:
    """Date of the newest report of each customer; of equal times the one with the latest date.

    Time and date are one number, so a single hash aggregation finds both and nothing is joined back.
    """
    wide = "decimal(38,0)"
    days = F.unix_date("scorecard_date") + F.lit(_DAYS)
    place = F.unix_micros("generated_at").cast(wide) * F.lit(2 * _DAYS).cast("decimal(10,0)") + days.cast("decimal(10,0)")
    newest = reports.groupBy("customer_id").agg(F.max(place.cast(wide)).alias("_place"))
    day = F.pmod(F.col("_place"), F.lit(2 * _DAYS).cast("decimal(10,0)")).cast("int") - F.lit(_DAYS)
    return newest.select("customer_id", F.date_from_unix_date(day).alias("scorecard_date"))


def score_comparison(
    reports: DataFrame, customers: DataFrame, cards: DataFrame
) -> DataFrame:
    """Composite score of the newest report of each customer, in id order."""
    return (
        newest_reports(reports).join(
            cards.select("customer_id", "scorecard_date", "composite_score"),
            ["customer_id", "scorecard_date"],
        )
        .join(customers.select("customer_id", "business_name"), "customer_id")
        .select(
            "customer_id",
            F.format_string("%s (%s)", "customer_id", "business_name").alias("label"),
            "composite_score",
        )
        .orderBy("customer_id")
    )


def find_reports(reports: DataFrame, cards: DataFrame) -> DataFrame:
    """Each report with its scorecard; filter on customer and date for a single one."""
    return reports.join(cards, ["customer_id", "scorecard_date"])


def customer_financials(customers: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Each customer with its rows of every source as ordered arrays.

    The natural keys bound an array at 1212 monthly or 36 890 daily rows. Not part of the
    scoring path.
    """
    result = customers
    for name, order in CHILD_ORDER.items():
        if name not in tables:
            continue
        rows = tables[name]
        rest = [c for c in rows.columns if c not in ("customer_id", *order)]
        nested = rows.groupBy("customer_id").agg(
            F.sort_array(F.collect_list(F.struct(*order, *rest))).alias(name)
        )
        result = result.join(nested, "customer_id", "left")
    empty = {n: F.coalesce(F.col(n), F.array().cast(result.schema[n].dataType)) for n in tables}
    return result.withColumns(empty)


def row_counts(customers: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """How many rows each customer has per source."""
    result = customers.select("customer_id")
    for name, rows in tables.items():
        counted = rows.groupBy("customer_id").agg(F.count(F.lit(1)).alias(f"{name}_rows"))
        result = result.join(counted, "customer_id", "left")
    return result.fillna(0)
