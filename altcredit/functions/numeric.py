"""Rounding, ratios and order statistics as Column expressions.

Money is summed as integer paise and divided once at the end, so a result never depends on
how the rows were partitioned. Squares are summed as DECIMAL(38,0) for the same reason.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE = "decimal(38,0)"


def rnd(x: Column, places: int = 0) -> Column:
    """Half-even rounding of a double."""
    if places == 0:
        return F.rint(x)
    scale = F.lit(float(10**places))
    return F.rint(x * scale) / scale


def rnd_long(x: Column) -> Column:
    return F.rint(x).cast("long")


def dbl(x: Column) -> Column:
    return x.cast("double")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double quotient; NULL for a zero or NULL denominator."""
    return F.try_divide(dbl(numerator), dbl(denominator))


def mean_rupees(total_paise: Column, n: Column) -> Column:
    return ratio(total_paise, n * F.lit(100))


def square(x: Column) -> Column:
    """Exact square of an integer column."""
    wide = x.cast("decimal(19,0)")
    return (wide * wide).cast(WIDE)


def _spread(n: Column, total: Column, total_sq: Column) -> Column:
    """n * sum(x^2) - sum(x)^2, exact."""
    wide = total.cast("decimal(19,0)")
    return dbl((n.cast("decimal(10,0)") * total_sq).cast(WIDE) - (wide * wide).cast(WIDE))


def sample_std(n: Column, total: Column, total_sq: Column) -> Column:
    """Sample standard deviation from sums; 0 for a single value, NULL for none."""
    return F.when(n == 1, F.lit(0.0)).when(
        n > 1, F.sqrt(ratio(_spread(n, total, total_sq), n * (n - F.lit(1))))
    )


def coefficient_of_variation(n: Column, total: Column, total_sq: Column) -> Column:
    """Sample deviation over mean; NULL without data or with a zero mean, 0 for one value."""
    return F.when(
        (n > 0) & (total != 0),
        F.when(n == 1, F.lit(0.0)).otherwise(ratio(sample_std(n, total, total_sq), ratio(total, n))),
    )


def cagr(first: Column, last: Column, years: float = 1.0) -> Column:
    """Compound growth as a fraction; NULL unless the first value is positive."""
    growth = ratio(last, first)
    if years != 1.0:
        growth = F.pow(growth, F.lit(1.0 / years))
    return F.when(first > 0, growth - F.lit(1.0))


def change(previous: Column, current: Column) -> Column:
    """(current - previous) / previous; NULL when the previous value is 0."""
    return ratio(current - previous, previous)


def slope(n: Column, total: Column, indexed_total: Column) -> Column:
    """Least-squares slope of values against their position 0..n-1; 0 below two points.

    ``indexed_total`` is sum(position * value). The position sums have closed forms, so only
    the value sums have to be aggregated.
    """
    wide_n = n.cast("decimal(10,0)")
    position_sum = (n * (n - F.lit(1)) / F.lit(2)).cast("decimal(19,0)")
    above = (wide_n * indexed_total.cast("decimal(19,0)")).cast(WIDE) - (
        position_sum * total.cast("decimal(19,0)")
    ).cast(WIDE)
    m = dbl(n)
    below = m * m * (m * m - F.lit(1.0)) / F.lit(12.0)
    return F.when(n >= 2, ratio(above, below)).when(n.isNotNull(), F.lit(0.0))


def percent(fraction: Column, places: int = 1) -> Column:
    return rnd(fraction * F.lit(100.0), places)


def number_text(x: Column) -> Column:
    """A double as the shortest decimal text, never in exponent form (2.09, 20.0, 12345678.9).

    Beyond 34 digits before the point the exponent form stays.
    """
    plain = x.cast("string")
    long_form = F.regexp_replace(x.try_cast("decimal(38,4)").cast("string"), r"(\.\d+?)0+$", "$1")
    return F.when(F.abs(x) < F.lit(1e7), plain).otherwise(F.coalesce(long_form, plain))


def paise_to_lakh(paise: Column) -> Column:
    return rnd(dbl(paise) / F.lit(1e7), 2)


def rupees_to_lakh(rupees: Column) -> Column:
    return rnd(dbl(rupees) / F.lit(1e5), 2)


def paise_to_rupees(paise: Column) -> Column:
    return rnd(dbl(paise) / F.lit(100.0), 2)
