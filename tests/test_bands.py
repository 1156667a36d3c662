from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from altcredit.functions import bands as bd
from altcredit.operators import scoring

CASES = {
    "dscr_score": [(None, 0), (1.75, 100), (1.74, 70), (1.25, 70), (1.24, 40), (1.0, 40), (0.99, 0)],
    "cheque_returns_score": [(0, 100), (1, 60), (2, 0)],
    "cash_withdrawal_score": [(None, 0), (5.0, 100), (5.1, 70), (15.0, 70), (15.1, 0)],
    "filing_delays_score": [(None, 100), (0, 100), (1, 70), (2, 70), (3, 0)],
    "revenue_cv_score": [(None, 0), (15.0, 100), (15.1, 70), (30.0, 70), (30.1, 40), (40.0, 40), (40.1, 0)],
    "growth_trend_score": [(None, 70), (1.1, 100), (1.0, 70), (-1.0, 70), (-1.1, 0)],
    "active_days_score": [(90.0, 100), (89.9, 70), (70.0, 70), (69.9, 0)],
    "ticket_cv_score": [(None, 0), (30.0, 100), (30.1, 70), (50.0, 70), (50.1, 0)],
    "frequency_score": [(80.0, 100), (79.9, 70), (40.0, 70), (39.9, 0)],
    "employee_growth_score": [(None, 70), (0.1, 100), (0.0, 70), (-0.1, 0)],
    "contributions_score": [(0, 100), (2, 70), (3, 0)],
    "score_word": [(85, "Excellent"), (84, "Good"), (70, "Good"), (69, "Fair"), (50, "Fair"), (49, "Weak"), (30, "Weak"), (29, "Poor")],
    "dscr_words": [
        (None, "not available"),
        (1.75, "strong repayment capacity"),
        (1.25, "acceptable repayment capacity"),
        (1.0, "modest, borderline repayment capacity"),
        (0.99, "weak repayment capacity"),
    ],
    "cv_words": [
        (None, "not available"),
        (14.9, "very stable"),
        (15.0, "normal, moderate volatility"),
        (30.0, "elevated volatility"),
        (40.0, "highly volatile"),
    ],
    "active_days_words": [
        (None, "not available"),
        (90.0, "consistent, near-daily activity"),
        (70.0, "regular but uneven activity"),
        (69.9, "sparse, irregular activity"),
    ],
    "gauge": [(39, "red"), (40, "yellow"), (69, "yellow"), (70, "green"), (100, "green")],
}


@pytest.mark.parametrize("name", CASES)
def test_bands(spark, name):
    cases = CASES[name]
    rows = spark.createDataFrame(
        [(i, float(v) if v is not None else None) for i, (v, _) in enumerate(cases)], "i int, v double"
    )
    got = rows.select("i", bd.band(name.removesuffix("_score"), F.col("v")).alias("s")).orderBy("i").collect()
    assert [r.s for r in got] == [want for _, want in cases]


@pytest.mark.parametrize(
    "balance, expenses, want",
    [(0, 0, 100), (5, -1, 100), (225, 100, 100), (224, 100, 70), (150, 100, 70), (149, 100, 40), (75, 100, 40), (74, 100, 0)],
)
def test_balance_cover(spark, balance, expenses, want):
    row = spark.createDataFrame([(balance, expenses)], "aa_avg_daily_balance long, aa_avg_monthly_operating_expenses long")
    got = row.select(bd.band("balance_cover", scoring.band_inputs()["balance_cover"])).collect()
    assert got[0][0] == want


def test_composite_ties_follow_double_addition(spark):
    """All attainable totals ending in .5, against the same additions in plain Python."""
    values = sorted({round(0.4 * a + 0.3 * b + 0.2 * c + 0.1 * d) for a in (0, 40, 70, 100) for b in (0, 40, 70, 100) for c in (0, 60, 100) for d in (0, 70, 100)})
    rows = [(a, g, u, e, 80) for a in values[::3] for g in (0, 35, 50, 70, 85, 100) for u in (0, 41, 70, 94) for e in (0, 35, 50, 70, 85, 100)]
    frame = spark.createDataFrame(rows, ", ".join(f"{d} int" for d in bd.WEIGHTS))
    got = frame.select(*bd.WEIGHTS, bd.composite().alias("score")).collect()
    for r in got:
        total = 0.0
        for dim, weight in bd.WEIGHTS.items():
            total += r[dim] * weight
        assert r.score == round(total)
        assert 0 <= r.score <= 100
