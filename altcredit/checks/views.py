"""The source tables of the engine, derived from the benchmark tables.

``customer_id`` is the customer key as text from the first projection on, so that later
aggregations and joins on it can reuse the partitioning.

Line items are pre-aggregated per order before they meet ``orders``: the join is then one-to-one
on the order key, and a customer with a third of all orders is spread over its orders and months
until only its monthly rows are left.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = date(2025, 1, 1)
# Earlier scorecards: date of the card, first month not yet known, first UPI day not yet known.
EARLIER = (
    (date(2024, 7, 1), (1997, 7), date(2024, 5, 1)),
    (date(2024, 10, 1), (1999, 1), date(2024, 9, 1)),
)
CARD_DATES = (*[d for d, _, _ in EARLIER], AS_OF)

GST_COLUMNS = ("gstr_sales_paise", "tax_paid_paise", "filing_date", "is_delayed")
BANK_COLUMNS = (
    "total_credits_paise",
    "total_debits_paise",
    "payroll_paid_paise",
    "operating_expenses_paise",
    "tax_payments_paise",
    "existing_emi_paise",
    "operating_surplus_paise",
    "avg_daily_balance_paise",
    "dscr",
    "cheque_returns",
    "cash_withdrawals_paise",
)
EPFO_COLUMNS = (
    "employee_count",
    "monthly_payroll_paise",
    "avg_wage_paise",
    "contribution_date",
    "is_late_contribution",
    "employee_churn",
)
PERIOD = ("customer_id", "year", "month")


# Columns used of the benchmark tables; declared, so that opening a table needs no job.
SCHEMAS = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
    "l_linestatus string, l_shipdate timestamp_ntz",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def cents(x: Column) -> Column:
    return F.rint(x * F.lit(100)).cast("long")


def key(customer_id: Column | None = None) -> Column:
    return (customer_id if customer_id is not None else F.col("customer_id")).cast("long")


# Which customers have a source: reconciliation and scores must cope with absent ones.


def has_gst() -> Column:
    return key() % 5 != 0


def has_bank() -> Column:
    return key() % 11 != 0


def has_epfo() -> Column:
    return key() % 7 != 0


def _per_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-item sums per order; unused ones are pruned by the optimizer."""
    price, line = F.col("l_extendedprice"), F.col("l_linenumber")
    returned, status = F.col("l_returnflag") == "R", F.col("l_linestatus")
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.sum(cents(price * (1 - F.col("l_discount")))).alias("credits"),
            F.sum(cents(price * F.col("l_tax"))).alias("payroll"),
            F.sum(cents(price * F.col("l_discount"))).alias("opex"),
            F.sum(cents(price * F.lit(0.02))).alias("tax"),
            F.sum(cents(F.col("l_quantity") * 1500)).alias("emi"),
            F.sum(F.when(line == 7, cents(price)).otherwise(0)).alias("cash"),
            F.count_if(returned & (status == "F") & (line == 1)).alias("cheques"),
            F.count(F.lit(1)).alias("heads"),
            F.sum(cents(price * F.lit(0.04))).alias("wages"),
            F.max(returned & (status == "O") & (line == 6)).alias("late"),
            F.count_if(returned & (line == 5)).alias("churn"),
            F.max("l_shipdate").alias("shipped"),
        )
    )


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.year("o_orderdate").alias("year"),
        F.month("o_orderdate").alias("month"),
        F.col("o_orderdate").cast("date").alias("ordered"),
        "o_totalprice",
        ((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "P")).alias("urgent"),
    )


def _gst_aggregates() -> list[Column]:
    total = F.col("o_totalprice")
    return [
        F.sum(cents(total)).alias("gstr_sales_paise"),
        F.sum(cents(total * F.lit(0.18))).alias("tax_paid_paise"),
        F.max("ordered").alias("filing_date"),
        F.max("urgent").alias("is_delayed"),
    ]


def _line_aggregates() -> list[Column]:
    return [
        F.sum("credits").alias("total_credits_paise"),
        F.sum("payroll").alias("payroll_paid_paise"),
        F.sum("opex").alias("operating_expenses_paise"),
        F.sum("tax").alias("tax_payments_paise"),
        F.sum("emi").alias("existing_emi_paise"),
        F.sum("cash").alias("cash_withdrawals_paise"),
        F.sum("cheques").cast("int").alias("cheque_returns"),
        F.sum("heads").cast("int").alias("employee_count"),
        F.sum("wages").alias("monthly_payroll_paise"),
        F.max("late").alias("is_late_contribution"),
        F.sum("churn").cast("int").alias("employee_churn"),
        F.max("shipped").cast("date").alias("contribution_date"),
    ]


def _add_derived(monthly: DataFrame) -> DataFrame:
    spent = sum(
        (F.col(c) for c in ("operating_expenses_paise", "tax_payments_paise", "existing_emi_paise")),
        F.col("payroll_paid_paise"),
    )
    credits = F.col("total_credits_paise")
    cover = credits.cast("double") * F.lit(100) / F.col("existing_emi_paise").cast("double")
    return monthly.withColumns(
        {
            "total_debits_paise": spent,
            "operating_surplus_paise": credits - spent,
            "dscr": (F.rint(cover) / F.lit(100)).cast("decimal(8,2)"),
            "avg_wage_paise": F.expr("monthly_payroll_paise div employee_count"),
        }
    )


def _balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("customer_id"),
        cents(F.greatest("c_acctbal", F.lit(0.0)) * 3).alias("avg_daily_balance_paise"),
    )


def gst_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _orders(spark, sf_dir)
        .groupBy(*PERIOD)
        .agg(*_gst_aggregates())
        .select(*PERIOD, *GST_COLUMNS)
    )


def _line_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = _orders(spark, sf_dir), _per_order(spark, sf_dir)
    joined = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return _add_derived(joined.groupBy(*PERIOD).agg(*_line_aggregates()))


def bank_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = _line_months(spark, sf_dir)
    return months.join(_balances(spark, sf_dir), "customer_id").select(*PERIOD, *BANK_COLUMNS)


def epfo_payroll(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = _line_months(spark, sf_dir)
    known = _balances(spark, sf_dir).select("customer_id")
    return months.join(known, "customer_id", "left_semi").select(*PERIOD, *EPFO_COLUMNS)


def monthly_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three monthly sources side by side, from one scan of orders and one of lineitem.

    A customer lacking a source has NULL in that source's columns.
    """
    orders, lines = _orders(spark, sf_dir), _per_order(spark, sf_dir)
    joined = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    months = _add_derived(joined.groupBy(*PERIOD).agg(*_gst_aggregates(), *_line_aggregates()))
    months = months.join(_balances(spark, sf_dir), "customer_id")
    has = {
        **dict.fromkeys(GST_COLUMNS, has_gst()),
        **dict.fromkeys(BANK_COLUMNS, has_bank() & F.col("heads_known")),
        **dict.fromkeys(EPFO_COLUMNS, has_epfo() & F.col("heads_known")),
    }
    return months.withColumn("heads_known", F.col("employee_count").isNotNull()).select(
        *PERIOD, *[F.when(present, F.col(c)).alias(c) for c, present in has.items()]
    )


def upi_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    merchant, price = F.col("merchant"), F.col("l_extendedprice")
    quantity = F.col("l_quantity")
    amount = cents(quantity * (100 + ((price % 1000) * (merchant % 5)) / F.lit(20.0)))
    refunded = (F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1)
    # Lines without an amount leave days on which nothing was collected.
    unpaid = refunded | (F.col("l_linenumber") > 1 + merchant % 7)
    lines = table(spark, sf_dir, "lineitem").withColumn("merchant", F.expr("l_suppkey div 2"))
    daily = (
        lines.select(
            merchant.cast("string").alias("customer_id"),
            F.dayofyear("l_shipdate").alias("day"),
            F.when(unpaid, F.lit(0)).otherwise(amount).alias("paise"),
            quantity.cast("int").alias("quantity"),
        )
        .groupBy("customer_id", "day")
        .agg(F.sum("paise").alias("collections_paise"), F.sum("quantity").alias("transactions"))
    )
    when = F.date_add(F.lit(date(2024, 1, 1)), F.col("day") - 1)
    return daily.select(
        "customer_id",
        when.alias("txn_date"),
        F.date_format(when, "EEEE").alias("day_of_week"),
        "collections_paise",
        F.col("transactions").cast("int").alias("num_transactions"),
        F.expr("collections_paise div transactions").alias("avg_ticket_size_paise"),
    )


def raw_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer feed as text, with the faults that validation has to find."""
    k = F.col("c_custkey")
    long_gst = F.concat(F.lit(" 27abcde"), F.lpad(k.cast("string"), 8, "0"))
    short_gst = F.concat(F.lit("27abcde"), F.lpad(k.cast("string"), 7, "0"))
    registered = F.date_add(F.lit(date(2021, 6, 1)), (k % 1500).cast("int")).cast("string")
    return table(spark, sf_dir, "customer").select(
        k.cast("string").alias("customer_id"),
        F.when(k % 89 == 0, F.lit("   "))
        .otherwise(F.concat(F.lit("  "), "c_name", F.lit(" ")))
        .alias("business_name"),
        F.when(k % 3 == 0, F.lit(" food  &   beverage"))
        .otherwise(F.concat(F.lit(" "), F.lower("c_mktsegment"), F.lit("  services ")))
        .alias("sector"),
        F.when(k % 4 != 0, F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string"))).alias(
            "persona"
        ),
        F.when(k % 5 == 0, F.lit("not_registered"))
        .when(k % 7 == 0, short_gst)
        .otherwise(long_gst)
        .alias("gst_number"),
        F.when(k % 97 == 0, F.lit(""))
        .otherwise(F.concat(F.lit("abcde"), F.lpad((k % 10000).cast("string"), 4, "0"), F.lit("f ")))
        .alias("pan"),
        F.when(k % 83 == 0, F.lit("2023/01/05"))
        .when(k % 71 == 0, F.lit("2022-02-30"))
        .otherwise(registered)
        .alias("registration_date"),
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean customer master: every benchmark customer."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.cast("string").alias("customer_id"),
        F.col("c_name").alias("business_name"),
        F.initcap("c_mktsegment").alias("sector"),
        F.when(k % 4 != 0, F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string"))).alias(
            "persona"
        ),
        F.when(k % 5 == 0, F.lit("NOT_REGISTERED"))
        .otherwise(F.concat(F.lit("27ABCDE"), F.lpad(k.cast("string"), 8, "0")))
        .alias("gst_number"),
    )


def customer_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("customer_id")
    )


def registered_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer master that lacks every fiftieth customer, for the reference checks."""
    return customer_keys(spark, sf_dir).filter(key() % 50 != 0)


def rupees_text(paise: str) -> Column:
    """Paise as rupee text with two decimals."""
    whole = F.expr(f"cast({paise} div 100 as string)")
    return F.concat(whole, F.lit("."), F.lpad((F.col(paise) % 100).cast("string"), 2, "0"))


def _flaw(bad: list[tuple[Column, str | None]], good: Column) -> Column:
    chain = F.when(bad[0][0], F.lit(bad[0][1]))
    for when, text in bad[1:]:
        chain = chain.when(when, F.lit(text))
    return chain.otherwise(good)


def raw_gst_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = key()
    return gst_filings(spark, sf_dir).select(
        "customer_id",
        _flaw([(k % 37 == 0, "13"), (k % 43 == 0, "abc")], F.col("month").cast("string")).alias(
            "month"
        ),
        _flaw([(k % 41 == 0, "1999")], F.col("year").cast("string")).alias("year"),
        _flaw([(k % 47 == 0, "0")], rupees_text("gstr_sales_paise")).alias("gstr_sales"),
        _flaw([(k % 53 == 0, "-12.5"), (k % 59 == 0, "n/a")], rupees_text("tax_paid_paise")).alias(
            "tax_paid"
        ),
        _flaw([(k % 61 == 0, "2030-1-5")], F.col("filing_date").cast("string")).alias("filing_date"),
        _flaw([(k % 67 == 0, None)], F.col("is_delayed").cast("string")).alias("is_delayed"),
    )


def raw_upi_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, day = key(), F.dayofyear("txn_date")
    return upi_transactions(spark, sf_dir).select(
        "customer_id",
        _flaw(
            [(day % 97 == 0, "2031-12-31"), (day % 89 == 0, "31-12-2024")],
            F.col("txn_date").cast("string"),
        ).alias("date"),
        _flaw([(day % 83 == 0, "Wednesday-ish")], F.col("day_of_week")).alias("day_of_week"),
        _flaw([((k + day) % 79 == 0, "-5")], rupees_text("collections_paise")).alias("collections"),
        _flaw([((k + day) % 73 == 0, "0")], F.col("num_transactions").cast("string")).alias(
            "num_transactions"
        ),
        _flaw([(day % 71 == 0, None)], rupees_text("avg_ticket_size_paise")).alias(
            "avg_ticket_size"
        ),
    )


def _raw_bank() -> list[Column | str]:
    k = key()
    surplus = F.concat(
        F.when(F.col("operating_surplus_paise") < 0, F.lit("-")).otherwise(F.lit("")),
        F.expr("cast(abs(operating_surplus_paise) div 100 as string)"),
        F.lit("."),
        F.lpad((F.abs("operating_surplus_paise") % 100).cast("string"), 2, "0"),
    )
    return [
        "customer_id",
        _flaw([(k % 47 == 0, "0")], F.col("month").cast("string")).alias("month"),
        F.col("year").cast("string").alias("year"),
        _flaw([(k % 43 == 0, "-100")], rupees_text("total_credits_paise")).alias("total_credits"),
        rupees_text("total_debits_paise").alias("total_debits"),
        rupees_text("payroll_paid_paise").alias("payroll_paid"),
        _flaw([(k % 61 == 0, "NaN")], rupees_text("operating_expenses_paise")).alias(
            "operating_expenses"
        ),
        rupees_text("tax_payments_paise").alias("tax_payments"),
        rupees_text("existing_emi_paise").alias("existing_emi"),
        surplus.alias("operating_surplus"),
        rupees_text("avg_daily_balance_paise").alias("avg_daily_balance"),
        _flaw([(k % 37 == 0, "0"), (k % 41 == 0, "0.001")], F.col("dscr").cast("string")).alias(
            "dscr"
        ),
        _flaw([(k % 53 == 0, "1.9")], F.col("cheque_returns").cast("string")).alias(
            "cheque_returns"
        ),
        _flaw([(k % 59 == 0, "-1")], rupees_text("cash_withdrawals_paise")).alias(
            "cash_withdrawals"
        ),
    ]


def _raw_epfo() -> list[Column | str]:
    k = key()
    return [
        _flaw([(k % 53 == 0, None)], F.col("customer_id")).alias("customer_id"),
        F.col("month").cast("string").alias("month"),
        F.col("year").cast("string").alias("year"),
        _flaw([(k % 37 == 0, "0")], F.col("employee_count").cast("string")).alias("employee_count"),
        _flaw([(k % 43 == 0, "-7.25")], rupees_text("monthly_payroll_paise")).alias(
            "monthly_payroll"
        ),
        rupees_text("avg_wage_paise").alias("avg_wage"),
        _flaw([(k % 47 == 0, "2026-01-01")], F.col("contribution_date").cast("string")).alias(
            "contribution_date"
        ),
        F.col("is_late_contribution").cast("string").alias("is_late_contribution"),
        F.col("employee_churn").cast("string").alias("employee_churn"),
    ]


def raw_bank_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bank_statements(spark, sf_dir).select(*_raw_bank())


def raw_epfo_payroll(spark: SparkSession, sf_dir: str) -> DataFrame:
    return epfo_payroll(spark, sf_dir).select(*_raw_epfo())


def raw_line_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bank and the payroll feed side by side, a struct each, from one scan of their source."""
    months = _line_months(spark, sf_dir).join(_balances(spark, sf_dir), "customer_id")
    return months.select(F.struct(*_raw_bank()).alias("bank_statements"), F.struct(*_raw_epfo()).alias("epfo_payroll"))


RAW = {
    "customers": raw_customers,
    "gst_filings": raw_gst_filings,
    "upi_transactions": raw_upi_transactions,
    "bank_statements": raw_bank_statements,
    "epfo_payroll": raw_epfo_payroll,
}


def with_card_dates(rows: DataFrame, known: dict[date, Column]) -> DataFrame:
    """Repeats each row for every scorecard date on which it was already known."""
    dates = [F.when(when, F.lit(d)) for d, when in known.items()]
    every = F.array_compact(F.array(*dates, F.lit(AS_OF)))
    return rows.select("*", F.explode(every).alias("scorecard_date"))


def months_by_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    period = F.col("year") * 12 + F.col("month")
    known = {d: period < F.lit(y * 12 + m) for d, (y, m), _ in EARLIER}
    return with_card_dates(monthly_activity(spark, sf_dir), known)


def upi_by_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = {d: F.col("txn_date") < F.lit(day) for d, _, day in EARLIER}
    return with_card_dates(upi_transactions(spark, sf_dir), known)


def report_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which reports were generated and when; some customers skip the first date."""
    k = key()
    minutes = F.when(F.col("scorecard_date") == F.lit(AS_OF), (k * 7919) % 1440).otherwise(k % 600)
    return (
        with_card_dates(customer_keys(spark, sf_dir), {d: F.lit(True) for d, _, _ in EARLIER})
        .filter((F.col("scorecard_date") != F.lit(EARLIER[0][0])) | (k % 13 != 0))
        .select(
            "customer_id",
            "scorecard_date",
            F.lit("fallback").alias("generation_method"),
            F.timestamp_add(
                "MINUTE", minutes, F.col("scorecard_date").cast("timestamp")
            ).alias("generated_at"),
        )
    )


def feed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line of a GST feed in JSON for every order, as files would hold them.

    Some lines are cut off, some hold an array of two records, some are blank.
    """
    k = F.col("o_orderkey")
    day = F.col("o_orderdate").cast("date")
    orders = table(spark, sf_dir, "orders").withColumn("paise", cents(F.col("o_totalprice")))
    record = F.concat(
        F.lit('{"customer_id":"'), F.col("o_custkey").cast("string"),
        F.lit('","month":'), F.month(day).cast("string"),
        F.lit(',"year":'), F.year(day).cast("string"),
        F.lit(',"gstr_sales":"'), rupees_text("paise"),
        F.lit('","tax_paid":0,"filing_date":"'), day.cast("string"),
        F.lit('","is_delayed":false}'),
    )
    line = (
        F.when(k % 101 == 0, F.substring(record, F.lit(1), F.char_length(record) - 3))
        .when(k % 103 == 0, F.concat(F.lit("["), record, F.lit(","), record, F.lit("]")))
        .when(k % 107 == 0, F.lit("  "))
        .otherwise(record)
    )
    file = F.concat(F.lit("part"), (k % 7).cast("string"))
    return orders.select(k.alias("order_key"), file.alias("source_file"), line.alias("value"))
