"""Banding of ratios into scores and words: one table of bands, one function that evaluates them."""

from __future__ import annotations

import operator
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from altcredit.functions.numeric import dbl

# Weight of each dimension, in summing order.
WEIGHTS = {
    "aa_bank_cashflow": 0.35,
    "gst_quality": 0.25,
    "upi_behaviour": 0.20,
    "epfo_stability": 0.10,
    "compliance_bureau": 0.10,
}
# Scores used where no data source exists.
COMPLIANCE_SCORE = 80
UNREGISTERED_GST_SCORE = 50
DAYS_PER_YEAR = 365

Result = int | str
_TESTS = {">=": operator.ge, ">": operator.gt, "<=": operator.le, "<": operator.lt}
_NOT_AVAILABLE = "not available"


@dataclass(frozen=True)
class Band:
    """The result of the first step whose test the value passes, else ``rest``; ``missing`` for NULL."""

    steps: tuple[tuple[str, float, Result], ...]
    rest: Result
    missing: Result

    def of(self, value: Column) -> Column:
        chain = F.when(value.isNull(), F.lit(self.missing))
        for test, threshold, result in self.steps:
            chain = chain.when(_TESTS[test](value, F.lit(threshold)), F.lit(result))
        return chain.otherwise(F.lit(self.rest))


# Thresholds, scores and words. Words for 15.0 differ from its score on purpose: the
# score is full up to 15.0, the words are "very stable" only below it.
BANDS = {
    "dscr": Band(((">=", 1.75, 100), (">=", 1.25, 70), (">=", 1.0, 40)), 0, 0),
    "balance_cover": Band(((">=", 1.5, 100), (">=", 1.0, 70), (">=", 0.5, 40)), 0, 0),
    "cheque_returns": Band((("<=", 0, 100), ("<=", 1, 60)), 0, 0),
    "cash_withdrawal": Band((("<=", 5.0, 100), ("<=", 15.0, 70)), 0, 0),
    "filing_delays": Band((("<=", 0, 100), ("<=", 2, 70)), 0, 100),
    "revenue_cv": Band((("<=", 15.0, 100), ("<=", 30.0, 70), ("<=", 40.0, 40)), 0, 0),
    "growth_trend": Band(((">", 1, 100), (">=", -1, 70)), 0, 70),
    "active_days": Band(((">=", 90.0, 100), (">=", 70.0, 70)), 0, 0),
    "ticket_cv": Band((("<=", 30.0, 100), ("<=", 50.0, 70)), 0, 0),
    "frequency": Band(((">=", 80.0, 100), (">=", 40.0, 70)), 0, 0),
    "employee_growth": Band(((">", 0, 100), (">=", 0, 70)), 0, 70),
    "contributions": Band((("<=", 0, 100), ("<=", 2, 70)), 0, 0),
    "score_word": Band(
        ((">=", 85, "Excellent"), (">=", 70, "Good"), (">=", 50, "Fair"), (">=", 30, "Weak")), "Poor", "Poor"
    ),
    "gauge": Band((("<", 40, "red"), ("<", 70, "yellow")), "green", "green"),
    "dscr_words": Band(
        (
            (">=", 1.75, "strong repayment capacity"),
            (">=", 1.25, "acceptable repayment capacity"),
            (">=", 1.0, "modest, borderline repayment capacity"),
        ),
        "weak repayment capacity",
        _NOT_AVAILABLE,
    ),
    "cv_words": Band(
        (
            ("<", 15.0, "very stable"),
            ("<", 30.0, "normal, moderate volatility"),
            ("<", 40.0, "elevated volatility"),
        ),
        "highly volatile",
        _NOT_AVAILABLE,
    ),
    "active_days_words": Band(
        ((">=", 90.0, "consistent, near-daily activity"), (">=", 70.0, "regular but uneven activity")),
        "sparse, irregular activity",
        _NOT_AVAILABLE,
    ),
}


def band(name: str, value: Column) -> Column:
    return BANDS[name].of(value)


def expense_days(monthly_expenses: Column, days: float) -> Column:
    return dbl(monthly_expenses) / F.lit(30.0) * F.lit(days)


def weighted(*parts: tuple[Column, float]) -> Column:
    """Weighted sum of scores, added left to right in double and rounded half-even."""
    score, weight = parts[0]
    total = dbl(score) * F.lit(weight)
    for score, weight in parts[1:]:
        total = total + dbl(score) * F.lit(weight)
    return F.rint(total).cast("int")


def composite() -> Column:
    return weighted(*[(F.col(name), weight) for name, weight in WEIGHTS.items()])
