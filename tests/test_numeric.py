from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from altcredit.functions import numeric as nm


def value(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0][0]


def sums(values):
    n, s, sq = len(values), sum(values), sum(v * v for v in values)
    si = sum(i * v for i, v in enumerate(values))
    return (
        F.lit(n).cast("long"),
        F.lit(s).cast("long"),
        F.lit(str(sq)).cast(nm.WIDE),
        F.lit(si).cast("long"),
    )


@pytest.mark.parametrize(
    "x, places, want",
    [(2.5, 0, 2.0), (3.5, 0, 4.0), (-2.5, 0, -2.0), (0.125, 2, 0.12), (0.375, 2, 0.38), (7.0, 1, 7.0)],
)
def test_rounding_is_half_even(spark, x, places, want):
    assert value(spark, nm.rnd(F.lit(x), places)) == want


@pytest.mark.parametrize(
    "values, want",
    [([], None), ([5], 0.0), ([0, 0], None), ([0], None), ([3, 3, 3], 0.0), ([1, 3], math.sqrt(2) / 2)],
)
def test_coefficient_of_variation_edges(spark, values, want):
    n, s, sq, _ = sums(values)
    got = value(spark, nm.coefficient_of_variation(n, s, sq))
    assert got == (want if want is None else pytest.approx(want))


def test_cagr_and_change(spark):
    assert value(spark, nm.cagr(F.lit(0), F.lit(5))) is None
    assert value(spark, nm.cagr(F.lit(-1), F.lit(5))) is None
    assert value(spark, nm.cagr(F.lit(100), F.lit(121))) == pytest.approx(0.21)
    assert value(spark, nm.cagr(F.lit(100), F.lit(121), 2.0)) == pytest.approx(0.1)
    assert value(spark, nm.change(F.lit(0), F.lit(5))) is None
    assert value(spark, nm.change(F.lit(4), F.lit(5))) == 0.25
    assert value(spark, nm.change(F.lit(None).cast("long"), F.lit(5))) is None


@pytest.mark.parametrize("values, want", [([], 0.0), ([9], 0.0), ([1, 2, 3], 1.0), ([5, 5], 0.0)])
def test_slope_edges(spark, values, want):
    n, s, _, si = sums(values)
    assert value(spark, nm.slope(n, s, si)) == want


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(0, 10**12), min_size=2, max_size=24))
def test_sums_agree_with_numpy(spark, values):
    n, s, sq, si = sums(values)
    got = spark.range(1).select(nm.sample_std(n, s, sq), nm.slope(n, s, si)).collect()[0]
    scale = max(values) + 1
    assert got[0] == pytest.approx(np.std(values, ddof=1), rel=1e-9, abs=1e-9 * scale)
    assert got[1] == pytest.approx(np.polyfit(range(len(values)), values, 1)[0], rel=1e-6, abs=1e-9 * scale)


@pytest.mark.parametrize(
    "x, want",
    [(2.09, "2.09"), (20.0, "20.0"), (-10.4, "-10.4"), (0.0, "0.0"), (12345678.9, "12345678.9"), (1e7, "10000000.0"), (123456789.25, "123456789.25")],
)
def test_number_text(spark, x, want):
    assert value(spark, nm.number_text(F.lit(x))) == want


def test_unit_conversions(spark):
    assert value(spark, nm.paise_to_lakh(F.lit(12_345_678))) == 1.23
    assert value(spark, nm.rupees_to_lakh(F.lit(732_655))) == 7.33
    assert value(spark, nm.paise_to_rupees(F.lit(12_345))) == 123.45
