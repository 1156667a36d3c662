"""Fixed text of messages, flags, prompts and narratives, and the way values are put into it."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reasons given by the validation rules.
REQUIRED = "%s is required"
ODD_GST_NUMBER = (
    "gst_number '%s' is %d chars, expected 15 (or 'NOT_REGISTERED' for an NTC customer)"
)
IN_FUTURE = "%s '%s' is in the future"
MONTH_RANGE = "month %d out of range 1-12"
SALES_NOT_POSITIVE = "gstr_sales must be > 0 for a GST-registered customer"
NEGATIVE = "%s cannot be negative"
NOT_POSITIVE = "%s must be > 0"
DSCR_NOT_POSITIVE = "dscr %s must be > 0"
DEBITS_EXCEED = "total_debits (%d) exceeds total_credits (%d) - cash flow anomaly"
TRANSFORM_FAILED = "transform failed: "
WARNING_SUFFIX = " (warning)"
UNKNOWN_ID = "UNKNOWN"
# Outcome of a load.
SUCCESS = "SUCCESS"
PARTIAL = "PARTIAL"
FAILED = "FAILED"
FAILED_RECORDS = "%d record(s) failed validation"

# Flags.
WEAK_DSCR_FLAG = "Weak repayment capacity (DSCR %s)"
STRONG_DSCR_FLAG = "Strong repayment capacity (DSCR %s)"
CHEQUES_FLAG = "Liquidity stress (%d cheque bounces)"
NO_CHEQUES_FLAG = "Zero cheque bounces"
LATE_GST_FLAG = "Compliance risk (%d late GST filings)"
TIMELY_GST_FLAG = "All GST filings on time"
LATE_EPFO_FLAG = "Payroll stress (%d late EPFO contributions)"
FEWER_STAFF_FLAG = "Declining employee count (%d -> %d)"
MORE_STAFF_FLAG = "Employee growth of %s%%"
SALES_DECLINE_FLAG = "Revenue decline (%s%% YoY)"
SALES_GROWTH_FLAG = "Revenue growth of %s%% YoY"
CASH_FLOW_FLAG = "Unaccounted cash flow (GST vs AA ratio %s)"
WITHDRAWALS_FLAG = "High cash withdrawals (%s%% of collections)"
BUFFER_FLAG = "Healthy cash buffer (ADB covers 60+ days of expenses)"

# Prompt text. Placeholders are fact names.
PROMPT_GST = """GST ANALYSIS:
- Monthly Turnover Range: ₹{gst_min}L–₹{gst_max}L
- Growth Trend: {gst_growth}% YoY
- Revenue Stability (CV): {gst_cv}% → {cv_interpretation}
- Filing Timeliness: {gst_filing_delays} late filings (0 is excellent)"""

PROMPT_NO_GST = """GST ANALYSIS:
- Not GST-registered (New-to-Credit customer) -- no GST data available"""

PROMPT = """Generate a financial health report for this MSME. Use ONLY these facts:

Customer: {customer_name} | {sector} | GST: {gst_number}

FINANCIAL METRICS:
- Composite Score: {composite_score}/100 → {score_interpretation}
- Business Health: Based on {months} months of transaction history ending {scorecard_date}

{gst_section}

UPI ANALYSIS:
- Average Daily Collections: ₹{upi_avg_daily}
- Transaction Frequency: {upi_transactions_count} total transactions
- Active Days: {upi_active_days}/365 days
- Transaction Pattern: {upi_pattern_interpretation}

BANK STATEMENT ANALYSIS:
- Average Monthly Credits: ₹{aa_avg_credits}L
- Average Daily Balance: ₹{aa_adb}L
- DSCR: {dscr} → {dscr_interpretation}
- Cheque Returns: {cheque_returns} (0 is excellent)
- Cash Withdrawal %: {cash_withdrawal_pct}% of inflows

PAYROLL ANALYSIS:
- Employee Count Growth: {employee_growth}% YoY
- Average Monthly Payroll: ₹{payroll_avg}
- Contribution Timeliness: {epfo_delays} late payments (0 is excellent)

CROSS-VALIDATION:
- GST vs Bank Credits Ratio: {gst_aa_ratio}
- GST vs UPI Ratio: {gst_upi_ratio}
{cross_validation_flags}

RISK INDICATORS:
{red_flags_list}

STRENGTH INDICATORS:
{green_flags_list}

Generate:
1. Executive summary (2 sentences)
2. Financial health assessment (2 sentences)
3. Key strengths (2-3 bullet points)
4. Key risks (2-3 bullet points)
5. Recommended next steps (1-2 sentences)

Remember: Only use facts provided above. Cite data source for each claim."""

# Narrative text.
SUMMARY = (
    "{customer_name} ({sector}) has a composite financial health score of "
    "{composite_score}/100, rated {score_interpretation} (per Analytics Engine)."
)
HEALTH_WITH_BANK = (
    "Based on {months} months of transaction history, DSCR is {dscr}, indicating "
    "{dscr_interpretation} (per bank statements)."
)
HEALTH_WITHOUT_BANK = (
    "Based on {months} months of transaction history, bank statement (AA) data is not "
    "available for this customer."
)
HEALTH_GST = " GST revenue volatility (CV={gst_cv}%) shows {cv_interpretation} (per GST data)."
FLAG_SOURCE = " (per Analytics Engine flags)"
NO_STRENGTHS = "No specific strengths flagged by Analytics Engine for this period"
NO_RISKS = "No specific risks flagged by Analytics Engine for this period"
RECOMMEND_REVIEW = (
    "Recommend reviewing the flagged risk indicators above with the customer before proceeding "
    "(per Analytics Engine risk flags)."
)
RECOMMEND_MONITORING = (
    "No red flags recorded; standard periodic monitoring is sufficient (per Analytics Engine)."
)
# Bullet lists.
NO_FLAGS = "None recorded"
NO_MISMATCHES = "- No cross-validation mismatches detected"
MISMATCHES = {
    "gst_vs_aa": "GST vs AA credits mismatch (ratio %s)",
    "gst_vs_upi": "GST vs UPI mismatch (ratio %s)",
    "aa_payroll_vs_epfo_payroll": "AA payroll vs EPFO payroll mismatch (ratio %s)",
    "upi_vs_aa_credits": "UPI vs AA credits mismatch (ratio %s)",
}
# Chart titles, sources and labels.
GAUGE_TITLE = "Composite Financial Health Score"
GAUGE_SOURCE = "Analytics Engine - Composite Score"
DIMENSION_TITLE = "Dimension Scores"
DIMENSION_SOURCE = "Analytics Engine - Dimension Scores"
GST_TREND_TITLE = "GST Monthly Revenue Trend (₹)"
GST_TREND_SOURCE = "GST Analytics Engine"
UPI_TREND_TITLE = "UPI Monthly Collections Trend (₹)"
UPI_TREND_SOURCE = "UPI Analytics Engine (no GST data available for this customer)"
HEADCOUNT_TITLE = "Employee Count Trend"
HEADCOUNT_SOURCE = "EPFO Analytics Engine"
CROSS_TITLE = "Cross-Validation: Data Source Reconciliation"
CROSS_SOURCE = "Cross-Validation Analytics"
CROSS_COLUMNS = ("Metric", "Ratio", "Status")
CROSS_LABELS = {
    "gst_vs_aa": "GST vs Bank Credits",
    "gst_vs_upi": "GST vs UPI Collections",
    "aa_payroll_vs_epfo_payroll": "AA Payroll vs EPFO Payroll",
    "upi_vs_aa_credits": "UPI vs AA Credits",
}
ALIGNED = "✅ Aligned"
MISMATCH = "⚠️ Mismatch"
NA = "NA"


def fill(template: str, **values: Column) -> Column:
    """The template with each ``{name}`` replaced by a column: a given one, else that name."""
    parts = []
    for i, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        if i % 2 == 0:
            if piece:
                parts.append(F.lit(piece))
        else:
            # A value that does not exist reads as "None".
            value = values.get(piece, F.col(piece))
            parts.append(F.coalesce(value.cast("string"), F.lit("None")))
    return F.concat(*parts)


def bullets(items: Column, empty: str) -> Column:
    lines = F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")
    return F.when(F.size(items) == 0, F.lit(empty)).otherwise(lines)


def month_label(year: Column, month: Column) -> Column:
    return F.date_format(F.make_date(year, month, F.lit(1)), "MMM yyyy")
