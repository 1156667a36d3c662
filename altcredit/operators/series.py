"""Chart series in long form: one row per point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from altcredit.functions import wording as wd
from altcredit.functions.bands import WEIGHTS
from altcredit.functions.numeric import number_text, paise_to_rupees


def dimension_long(cards: DataFrame) -> DataFrame:
    """Five rows per scorecard: dimension, score."""
    pairs = [
        F.struct(F.lit(i).alias("position"), F.lit(d).alias("dimension"), F.col(d).alias("score"))
        for i, d in enumerate(WEIGHTS)
    ]
    return cards.select("customer_id", F.inline(F.array(*pairs)))


def mismatch_text(flag: Column) -> Column:
    return (
        F.when(flag.isNull(), F.lit(wd.NA))
        .when(flag, F.lit(wd.MISMATCH))
        .otherwise(F.lit(wd.ALIGNED))
    )


def cross_validation_long(cards: DataFrame) -> DataFrame:
    """Four rows per scorecard: metric, ratio or NA, status."""
    rows = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(label).alias("metric"),
            F.coalesce(number_text(F.col(f"cross_{name}_ratio")), F.lit(wd.NA)).alias("ratio"),
            mismatch_text(F.col(f"cross_{name}_mismatch")).alias("status"),
        )
        for i, (name, label) in enumerate(wd.CROSS_LABELS.items())
    ]
    return cards.select("customer_id", F.inline(F.array(*rows)))


def _points(rows: DataFrame, value: Column, series: str) -> DataFrame:
    return rows.select(
        "customer_id",
        "year",
        "month",
        wd.month_label(F.col("year"), F.col("month")).alias("label"),
        value.alias("value"),
        F.lit(series).alias("series"),
    )


def upi_months(upi: DataFrame) -> DataFrame:
    """Daily UPI rows rolled up to calendar months."""
    return upi.groupBy(
        "customer_id", F.year("txn_date").alias("year"), F.month("txn_date").alias("month")
    ).agg(F.sum("collections_paise").alias("collections_paise"))


def revenue_trend(gst: DataFrame, upi: DataFrame) -> DataFrame:
    """Monthly sales in rupees: GST, or UPI collections for a customer without GST filings.

    UPI is rolled up to months, and GST to one row per customer, before they meet.
    """
    filed = gst.groupBy("customer_id").agg(F.lit(True).alias("filed")).select("customer_id")
    collected = upi_months(upi).join(filed, "customer_id", "left_anti")
    return _points(gst, paise_to_rupees(F.col("gstr_sales_paise")), "gst_sales").unionByName(
        _points(collected, paise_to_rupees(F.col("collections_paise")), "upi_collections")
    )


def headcount_trend(epfo: DataFrame) -> DataFrame:
    return _points(epfo, F.col("employee_count").cast("double"), "employee_count")


def _nested(points: DataFrame, value: Column, name: str) -> DataFrame:
    """Points of one customer as an ordered array; a customer has at most 1212 months."""
    point = F.struct("year", "month", F.col("label"), value.alias("value"))
    ordered = F.sort_array(F.collect_list(point))
    return points.groupBy("customer_id").agg(
        F.first("series").alias(f"{name}_series"),
        F.transform(
            ordered, lambda p: F.struct(p["label"].alias("month"), p["value"].alias("value"))
        ).alias(f"{name}_points"),
    )


def chart_inputs(gst: DataFrame, upi: DataFrame, epfo: DataFrame) -> list[DataFrame]:
    """Ordered trend points per customer, to be left-joined to the scorecards."""
    return [
        _nested(revenue_trend(gst, upi), F.col("value"), "revenue"),
        _nested(headcount_trend(epfo), F.col("value").cast("int"), "headcount"),
    ]


def _chart(kind: str, title: str, source: str, **parts: Column) -> Column:
    return F.to_variant_object(
        F.struct(
            F.lit(kind).alias("type"),
            F.lit(title).alias("title"),
            *[value.alias(name) for name, value in parts.items()],
            F.lit(source).alias("source"),
        )
    )


def _line(title: str, source: str, y_key: str, points: str) -> Column:
    return _chart(
        "line", title, source, x_key=F.lit("month"), y_key=F.lit(y_key), data=F.col(points)
    )


def chart_configs() -> Column:
    """The charts of one report, over flat scorecard columns and ``chart_inputs``."""

    def variant(x: Column) -> Column:
        return x.cast("variant")

    # Limits of the gauge bands.
    limits = F.struct(
        F.array(F.lit(0), F.lit(40)).alias("red"),
        F.array(F.lit(40), F.lit(70)).alias("yellow"),
        F.array(F.lit(70), F.lit(100)).alias("green"),
    )
    rows = [
        F.array(
            variant(F.lit(label)),
            F.coalesce(variant(F.col(f"cross_{name}_ratio")), variant(F.lit(wd.NA))),
            variant(mismatch_text(F.col(f"cross_{name}_mismatch"))),
        )
        for name, label in wd.CROSS_LABELS.items()
    ]
    revenue = F.when(
        F.col("revenue_series") == "gst_sales",
        _line(wd.GST_TREND_TITLE, wd.GST_TREND_SOURCE, "gst_sales", "revenue_points"),
    ).when(
        F.col("revenue_series") == "upi_collections",
        _line(wd.UPI_TREND_TITLE, wd.UPI_TREND_SOURCE, "upi_collections", "revenue_points"),
    )
    headcount = F.when(
        F.col("headcount_points").isNotNull(),
        _line(wd.HEADCOUNT_TITLE, wd.HEADCOUNT_SOURCE, "employee_count", "headcount_points"),
    )
    return F.array_compact(
        F.array(
            _chart(
                "gauge",
                wd.GAUGE_TITLE,
                wd.GAUGE_SOURCE,
                data_value=F.col("composite_score"),
                min=F.lit(0),
                max=F.lit(100),
                thresholds=limits,
            ),
            _chart(
                "bar",
                wd.DIMENSION_TITLE,
                wd.DIMENSION_SOURCE,
                categories=F.array(*[F.lit(d) for d in WEIGHTS]),
                data=F.array(*[F.col(d) for d in WEIGHTS]),
            ),
            _chart(
                "table",
                wd.CROSS_TITLE,
                wd.CROSS_SOURCE,
                columns=F.array(*[F.lit(c) for c in wd.CROSS_COLUMNS]),
                rows=F.array(*rows),
            ),
            revenue,
            headcount,
        )
    )
