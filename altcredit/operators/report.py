"""Report datasets: facts, prompt text, narrative and audit counts, all as projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from altcredit.functions import bands as bd
from altcredit.functions import numeric as nm
from altcredit.functions import wording as wd

# Facts that count as cited ratios when they have a value.
RATIO_FACTS = (
    "gst_growth",
    "gst_cv",
    "gst_filing_delays",
    "upi_avg_daily",
    "upi_transactions_count",
    "upi_active_days",
    "aa_avg_credits",
    "aa_adb",
    "dscr",
    "cheque_returns",
    "cash_withdrawal_pct",
    "employee_growth",
    "payroll_avg",
    "epfo_delays",
    "gst_aa_ratio",
    "gst_upi_ratio",
)
DEFAULT_MONTHS = 12


def _number(name: str) -> Column:
    return nm.number_text(F.col(name))


def _or_na(text: Column) -> Column:
    return F.coalesce(text, F.lit(wd.NA))


def _if_source(available: str, text: Column) -> Column:
    return F.when(F.col(available), text).otherwise(F.lit(wd.NA))


def mismatch_lines() -> Column:
    found = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col(f"cross_{name}_mismatch"),
                    F.format_string(text, _number(f"cross_{name}_ratio")),
                )
                for name, text in wd.MISMATCHES.items()
            ]
        )
    )
    return wd.bullets(found, wd.NO_MISMATCHES)


def with_customer(cards: DataFrame, customers: DataFrame, gst_sums: DataFrame) -> DataFrame:
    """Flat scorecards joined with customer names and the monthly sales range."""
    names = customers.select("customer_id", "business_name", "sector", "gst_number")
    sales = gst_sums.select("customer_id", "gst_n", "gst_min_paise", "gst_max_paise")
    return cards.join(names, "customer_id").join(sales, "customer_id", "left")


def facts(cards: DataFrame, *passthrough: Column) -> DataFrame:
    """The 37 facts a report may cite, as text where a value may be "NA".

    Needs flat scorecard columns plus ``with_customer``'s. Months are counted as filing rows,
    which the natural key makes the same as distinct periods.
    """
    has_gst = F.col("gst_is_gst_registered") & (F.coalesce(F.col("gst_n"), F.lit(0)) > 0)

    def lakh(name: str) -> Column:
        text = nm.number_text(nm.paise_to_lakh(F.col(name)))
        return F.when(has_gst, text).otherwise(F.lit(wd.NA))

    def rupee_lakh(name: str) -> Column:
        return _if_source("aa_available", nm.number_text(nm.rupees_to_lakh(F.col(name))))

    def whole(name: str) -> Column:
        return F.col(name).cast("string")

    return cards.select(
        *passthrough,
        "customer_id",
        F.col("business_name").alias("customer_name"),
        "sector",
        "gst_number",
        F.col("scorecard_date").cast("string").alias("scorecard_date"),
        F.when(F.col("gst_n") > 0, F.col("gst_n")).otherwise(F.lit(DEFAULT_MONTHS)).alias("months"),
        "composite_score",
        "score_interpretation",
        F.col("gst_is_gst_registered").alias("is_gst_registered"),
        lakh("gst_min_paise").alias("gst_min"),
        lakh("gst_max_paise").alias("gst_max"),
        _or_na(_number("gst_cagr_percent")).alias("gst_growth"),
        _or_na(_number("gst_cv_percent")).alias("gst_cv"),
        bd.band("cv_words", F.col("gst_cv_percent")).alias("cv_interpretation"),
        _or_na(whole("gst_filing_delays")).alias("gst_filing_delays"),
        whole("upi_avg_daily_collections").alias("upi_avg_daily"),
        whole("upi_total_transactions").alias("upi_transactions_count"),
        whole("upi_active_days").alias("upi_active_days"),
        bd.band("active_days_words", F.col("upi_active_days_percent")).alias("upi_pattern_interpretation"),
        F.col("aa_available").alias("is_aa_available"),
        rupee_lakh("aa_avg_monthly_credits").alias("aa_avg_credits"),
        rupee_lakh("aa_avg_daily_balance").alias("aa_adb"),
        _if_source("aa_available", _number("aa_dscr")).alias("dscr"),
        bd.band("dscr_words", F.col("aa_dscr")).alias("dscr_interpretation"),
        _if_source("aa_available", whole("aa_cheque_return_count")).alias("cheque_returns"),
        _if_source("aa_available", _number("aa_cash_withdrawal_percent")).alias(
            "cash_withdrawal_pct"
        ),
        F.col("epfo_available").alias("is_epfo_available"),
        _or_na(_number("epfo_employee_growth_percent")).alias("employee_growth"),
        _if_source("epfo_available", whole("epfo_avg_monthly_payroll")).alias("payroll_avg"),
        _if_source("epfo_available", whole("epfo_contribution_timeliness_late_count")).alias(
            "epfo_delays"
        ),
        _or_na(_number("cross_gst_vs_aa_ratio")).alias("gst_aa_ratio"),
        _or_na(_number("cross_gst_vs_upi_ratio")).alias("gst_upi_ratio"),
        mismatch_lines().alias("cross_validation_flags"),
        "red_flags",
        "green_flags",
        wd.bullets(F.col("red_flags"), wd.NO_FLAGS).alias("red_flags_list"),
        wd.bullets(F.col("green_flags"), wd.NO_FLAGS).alias("green_flags_list"),
    )


def prompt_text() -> Column:
    """The report prompt over the facts columns."""
    section = F.when(F.col("is_gst_registered"), wd.fill(wd.PROMPT_GST)).otherwise(
        F.lit(wd.PROMPT_NO_GST)
    )
    return wd.fill(wd.PROMPT, gst_section=section)


def _claims(flag_list: str, none_text: str) -> Column:
    cited = F.transform(flag_list, lambda x: F.concat(x, F.lit(wd.FLAG_SOURCE)))
    return F.when(F.size(flag_list) == 0, F.array(F.lit(none_text))).otherwise(cited)


def narrative_columns() -> dict[str, Column]:
    """The rule-based narrative over the facts columns."""
    health = F.when(F.col("dscr") != wd.NA, wd.fill(wd.HEALTH_WITH_BANK)).otherwise(
        wd.fill(wd.HEALTH_WITHOUT_BANK)
    )
    volatility = F.when(
        F.col("is_gst_registered") & (F.col("gst_cv") != wd.NA), wd.fill(wd.HEALTH_GST)
    ).otherwise(F.lit(""))
    return {
        "summary": wd.fill(wd.SUMMARY),
        "financial_health": F.concat(health, volatility),
        "strengths": _claims("green_flags", wd.NO_STRENGTHS),
        "risks": _claims("red_flags", wd.NO_RISKS),
        "recommendations": F.when(F.size("red_flags") > 0, F.lit(wd.RECOMMEND_REVIEW)).otherwise(
            F.lit(wd.RECOMMEND_MONITORING)
        ),
    }


NARRATIVE = ("summary", "financial_health", "strengths", "risks", "recommendations")


def cited_ratios() -> Column:
    """How many of the ratio facts have a value."""
    values = F.array_compact(F.array(*[F.col(name) for name in RATIO_FACTS]))
    return F.size(F.array_remove(values, wd.NA))


def audit_columns() -> dict[str, Column]:
    """What the report rests on, over the facts and narrative columns."""
    sources = [
        F.when(F.col("is_gst_registered"), F.lit("GST")),
        F.lit("UPI"),
        F.when(F.col("is_aa_available"), F.lit("AA")),
        F.when(F.col("is_epfo_available"), F.lit("EPFO")),
    ]
    return {
        "data_sources_used": F.array_compact(F.array(*sources)),
        "ratios_cited": cited_ratios(),
        # Summary and health, the bullets, and the recommendations.
        "total_claims": F.lit(3) + F.size("strengths") + F.size("risks"),
    }


def narrative(fact_rows: DataFrame) -> DataFrame:
    return fact_rows.withColumns(narrative_columns())


def audit_trail(fact_rows: DataFrame) -> DataFrame:
    return narrative(fact_rows).withColumns(audit_columns())
