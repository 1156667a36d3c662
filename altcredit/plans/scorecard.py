"""Scorecards for all customers in one job."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from altcredit.operators import ratios as rt
from altcredit.operators import scoring as sc
from altcredit.operators import summaries as sm
from altcredit.schemas import RATIO_SCHEMAS

_PREFIX = {
    "gst_ratios": "gst_",
    "upi_ratios": "upi_",
    "aa_ratios": "aa_",
    "epfo_ratios": "epfo_",
    "cross_validation": "cross_",
    "dimension_scores": "",
}
_AVAILABLE = {"aa_ratios": "aa_available", "epfo_ratios": "epfo_available"}

REQUIRED_FIELDS = (
    "customer_id",
    "scorecard_date",
    *_PREFIX,
    "composite_score",
    "score_interpretation",
    "red_flags",
    "green_flags",
)


def flat_columns(part: str) -> list[str]:
    """Flat column names of one part of the document."""
    return [_PREFIX[part] + field for field in RATIO_SCHEMAS[part].names]


def combine(
    customers: DataFrame, summaries: Sequence[DataFrame], keys: Sequence[str] = sm.KEYS
) -> DataFrame:
    """Customers with the sums of whichever sources they have.

    Every side is unique on the key and already partitioned by it, so no join shuffles or skews.
    """
    combined = customers
    for sums in summaries:
        combined = combined.join(sums, list(keys), "left")
    return combined


def all_ratios(sums: DataFrame) -> DataFrame:
    return rt.cross_validation(rt.epfo_ratios(rt.aa_ratios(rt.upi_ratios(rt.gst_ratios(sums)))))


def score(sums: DataFrame) -> DataFrame:
    """Ratios, cross-validation, dimension scores, composite and flags as flat columns."""
    return sc.flags(sc.composite_score(sc.dimension_scores(all_ratios(sums))))


def summarize_tables(
    gst: DataFrame, upi: DataFrame, bank: DataFrame, epfo: DataFrame, keys: Sequence[str] = sm.KEYS
) -> list[DataFrame]:
    """Sums of the four stored tables."""
    return [
        sm.summarize_monthly(gst, [sm.GST], keys),
        sm.summarize_upi(upi, keys),
        sm.summarize_monthly(bank, [sm.BANK], keys),
        sm.summarize_monthly(epfo, [sm.EPFO], keys),
    ]


def _packed(part: str) -> Column:
    fields = RATIO_SCHEMAS[part].fields
    packed = F.struct(*[F.col(_PREFIX[part] + f.name).cast(f.dataType).alias(f.name) for f in fields])
    if part in _AVAILABLE:
        packed = F.when(F.col(_AVAILABLE[part]), packed)
    return packed.alias(part)


def documents(scored: DataFrame) -> DataFrame:
    """Flat scored rows as scorecard documents; an absent bank or payroll source is NULL."""
    return scored.select(
        "customer_id",
        "scorecard_date",
        *[_packed(part) for part in _PREFIX],
        "composite_score",
        "score_interpretation",
        "red_flags",
        "green_flags",
    )


def flatten(cards: DataFrame) -> DataFrame:
    """The inverse of ``documents``: flat ratio columns from (decoded) scorecard documents.

    A source is absent if its part is NULL or, as in stored JSON, an empty object.
    """
    flat = [
        F.col(f"{part}.{field}").alias(_PREFIX[part] + field)
        for part in _PREFIX
        for field in RATIO_SCHEMAS[part].names
    ]
    return cards.select(
        "customer_id",
        "scorecard_date",
        *flat,
        *[
            F.col(part)[RATIO_SCHEMAS[part].names[0]].isNotNull().alias(name)
            for part, name in _AVAILABLE.items()
        ],
        "composite_score",
        "score_interpretation",
        "red_flags",
        "green_flags",
    )


def select_customers(
    customers: DataFrame, requested: DataFrame | None
) -> tuple[DataFrame, DataFrame | None]:
    """Customers to score and the requested ids that do not exist.

    No request means all customers; an empty one means none.
    """
    if requested is None:
        return customers, None
    ids = requested.select("customer_id").distinct()
    return (
        customers.join(ids, "customer_id", "left_semi"),
        ids.join(customers.select("customer_id"), "customer_id", "left_anti"),
    )


def only_requested(feeds: Sequence[DataFrame], requested: DataFrame | None) -> list[DataFrame]:
    """The feeds reduced to the requested customers, before anything is aggregated."""
    if requested is None:
        return list(feeds)
    ids = requested.select("customer_id").distinct()
    return [rows.join(ids, "customer_id", "left_semi") for rows in feeds]


def scorecards(
    customers: DataFrame,
    gst: DataFrame,
    upi: DataFrame,
    bank: DataFrame,
    epfo: DataFrame,
    as_of: date,
) -> DataFrame:
    """Scorecard documents of all given customers, dated ``as_of``."""
    return scorecards_of_sums(customers, summarize_tables(gst, upi, bank, epfo), as_of)


def scorecards_of_sums(customers: DataFrame, summaries: Sequence[DataFrame], as_of: date) -> DataFrame:
    """Scorecard documents from sums that are known already."""
    base = customers.select("customer_id", F.lit(as_of).alias("scorecard_date"))
    return documents(score(combine(base, summaries)))


def missing_fields(cards: DataFrame) -> list[str]:
    """Required document fields that a scorecard frame lacks."""
    return [f for f in REQUIRED_FIELDS if f not in cards.columns]


def _lacking() -> Column:
    always = [f for f in REQUIRED_FIELDS if f not in _AVAILABLE]
    return F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in always]))


def incomplete(cards: DataFrame) -> DataFrame:
    """Scorecards without a value in a field that is never NULL, and the names of those fields."""
    return cards.select("customer_id", "scorecard_date", _lacking().alias("missing")).filter(
        F.size("missing") > 0
    )


def complete(cards: DataFrame) -> DataFrame:
    """Scorecards with a value in every field that is never NULL."""
    return cards.filter(F.size(_lacking()) == 0)
