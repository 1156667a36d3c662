"""Declared schemas of the nine tables. Nothing in the package infers a schema."""

from __future__ import annotations

from pyspark.sql import types as T

CUSTOMER = "customer_id"

_TYPES: dict[str, T.DataType] = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
    "decimal(8,2)": T.DecimalType(8, 2),
}


def _struct(columns: str) -> T.StructType:
    """Schema of "name type, name type, ..."; unlike a DDL parse it needs no Spark session."""
    pairs = [c.split(" ") for c in columns.split(", ")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


_STAMPS = "created_at timestamp, updated_at timestamp"

_COLUMNS = {
    "customers": "customer_id string, business_name string, sector string, persona string, "
    f"gst_number string, pan string, registration_date date, {_STAMPS}",
    "gst_filings": "customer_id string, month int, year int, gstr_sales_paise bigint, "
    f"tax_paid_paise bigint, filing_date date, is_delayed boolean, {_STAMPS}",
    "upi_transactions": "customer_id string, txn_date date, day_of_week string, "
    f"collections_paise bigint, num_transactions int, avg_ticket_size_paise bigint, {_STAMPS}",
    "bank_statements": "customer_id string, month int, year int, total_credits_paise bigint, "
    "total_debits_paise bigint, payroll_paid_paise bigint, operating_expenses_paise bigint, "
    "tax_payments_paise bigint, existing_emi_paise bigint, operating_surplus_paise bigint, "
    "avg_daily_balance_paise bigint, dscr decimal(8,2), cheque_returns int, "
    f"cash_withdrawals_paise bigint, {_STAMPS}",
    "epfo_payroll": "customer_id string, month int, year int, employee_count int, "
    "monthly_payroll_paise bigint, avg_wage_paise bigint, contribution_date date, "
    f"is_late_contribution boolean, employee_churn int, {_STAMPS}",
    "data_lineage": "source_file string, table_name string, record_count bigint, "
    "load_timestamp timestamp, status string, error_message string",
    "validation_errors": "source_file string, table_name string, record_identifier string, "
    "error_reason string, logged_at timestamp",
    "scorecards": "customer_id string, scorecard_date date, scorecard_json string, "
    "composite_score int, created_at timestamp",
    "ai_reports": "customer_id string, scorecard_date date, report_json string, "
    "generation_method string, generated_at timestamp",
}

TABLES: dict[str, T.StructType] = {name: _struct(columns) for name, columns in _COLUMNS.items()}

_GST = (
    "is_gst_registered boolean, cagr_percent double, mom_growth_percent double, "
    "cv_percent double, filing_delays bigint, tax_payment_status string, "
    "itc_utilization_percent string, customer_concentration string"
)
_UPI = (
    "avg_daily_collections bigint, total_transactions bigint, avg_ticket_size bigint, "
    "active_days bigint, active_days_percent double, ticket_size_cv_percent double, "
    "repeat_customer_rate string, weekend_weekday_ratio double"
)
_AA = (
    "avg_monthly_credits bigint, monthly_credits_trend_slope double, "
    "monthly_credits_volatility_percent double, avg_daily_balance bigint, "
    "avg_monthly_operating_expenses bigint, cash_conversion_ratio double, dscr double, "
    "existing_debt_total_annual bigint, existing_debt_avg_monthly bigint, "
    "existing_debt_instrument_count string, cheque_return_count bigint, "
    "cash_withdrawal_percent double, days_sales_outstanding string"
)
_EPFO = (
    "starting_employee_count int, ending_employee_count int, employee_growth_percent double, "
    "avg_employee_count double, employee_count_trend_slope double, avg_monthly_payroll bigint, "
    "monthly_payroll_variance double, avg_wage bigint, wage_inflation_percent double, "
    "contribution_timeliness_late_count bigint, employee_churn_rate double"
)
_CROSS = (
    "gst_vs_aa_ratio double, gst_vs_aa_mismatch boolean, gst_vs_upi_ratio double, "
    "gst_vs_upi_mismatch boolean, aa_payroll_vs_epfo_payroll_ratio double, "
    "aa_payroll_vs_epfo_payroll_mismatch boolean, upi_vs_aa_credits_ratio double, "
    "upi_vs_aa_credits_mismatch boolean, gst_growth_vs_employee_growth string"
)
_DIMS = (
    "aa_bank_cashflow int, gst_quality int, upi_behaviour int, epfo_stability int, "
    "compliance_bureau int"
)

RATIO_SCHEMAS: dict[str, T.StructType] = {
    "gst_ratios": _struct(_GST),
    "upi_ratios": _struct(_UPI),
    "aa_ratios": _struct(_AA),
    "epfo_ratios": _struct(_EPFO),
    "cross_validation": _struct(_CROSS),
    "dimension_scores": _struct(_DIMS),
}

# One scorecard document: what a stored scorecard decodes to.
SCORECARD = T.StructType(
    [
        T.StructField("customer_id", T.StringType()),
        T.StructField("scorecard_date", T.DateType()),
        *[T.StructField(name, schema) for name, schema in RATIO_SCHEMAS.items()],
        T.StructField("composite_score", T.IntegerType()),
        T.StructField("score_interpretation", T.StringType()),
        T.StructField("red_flags", T.ArrayType(T.StringType())),
        T.StructField("green_flags", T.ArrayType(T.StringType())),
    ]
)
