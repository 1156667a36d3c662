"""Partial sums of blocks of time, and how they merge into the sums of ``summaries``.

A block is a year of a monthly source and a month of the daily one. Its sums are those of ``summaries``
with the block in the key. Merging keeps what depends on the order of the rows:

* the first and last values come from the first and last block that has one;
* the value before the last is the one of the last block, or, if that block has a single value, the last
  value of the block before it;
* a sum of values by their position is shifted by the number of values in earlier blocks: a value's
  position grows by that count, so the block's plain sum is added that many times.

So a month that arrives late, or is replaced, changes its own block only, and positions in later blocks
move when they are merged. A customer has at most 101 blocks a monthly source and 1212 of the daily
one, which bounds the window; merging is one shuffle on the customer, of blocks in place of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from altcredit.operators import summaries as sm
from altcredit.schemas import TABLES

BLOCK = "block"
BLOCK_KEYS = (*sm.KEYS, BLOCK)
SOURCES = {"gst_filings": sm.GST, "bank_statements": sm.BANK, "epfo_payroll": sm.EPFO}
DAILY = "upi_transactions"
SUMMED = (*SOURCES, DAILY)

#: Sums by position: the number of values and their plain sum.
_INDEXED = {
    "bank_credits_indexed": ("bank_n", "bank_credits"),
    "epfo_headcount_indexed": ("epfo_n", "epfo_headcount"),
}
_FIRST = ("gst_first", "epfo_first_headcount", "epfo_first_wage")
_LAST = ("gst_last", "epfo_last_headcount", "epfo_last_wage")
_LEAST, _MOST = ("gst_min_paise",), ("gst_max_paise",)
#: Values before the last one, by the last one.
_PREVIOUS = {"gst_previous": "gst_last"}


def block_of(table: str) -> Column:
    """The block of a row: its year, or for daily rows its month, counted from the year 0."""
    if table == DAILY:
        return F.year("txn_date") * F.lit(12) + F.month("txn_date") - F.lit(1)
    return F.col("year")


def block_sums(rows: DataFrame, table: str) -> DataFrame:
    """Sums of the rows of a stored table, one row per customer and block."""
    marked = rows.withColumn(BLOCK, block_of(table))
    if table == DAILY:
        return sm.summarize_upi(marked, BLOCK_KEYS)
    return sm.summarize_monthly(marked, [SOURCES[table]], BLOCK_KEYS)


def block_schema(spark: SparkSession, table: str):
    return block_sums(spark.createDataFrame([], TABLES[table]), table).schema


def merged_sums(blocks: DataFrame, keys: Sequence[str] = sm.KEYS) -> DataFrame:
    """Sums of all blocks of a customer: what ``summaries`` gives for all of its rows."""
    names = [c for c in blocks.columns if c not in (*keys, BLOCK)]
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    shifted = {
        name: F.col(name) + F.coalesce(F.sum(n).over(before), F.lit(0)) * F.col(total)
        for name, (n, total) in _INDEXED.items()
        if name in names
    }
    earlier = {
        name: F.coalesce(F.col(name), F.last(last, ignorenulls=True).over(before))
        for name, last in _PREVIOUS.items()
        if name in names
    }
    ordered = {**shifted, **earlier}
    placed = blocks.select(*keys, BLOCK, *[ordered.get(n, F.col(n)).alias(n) for n in names])
    return placed.groupBy(*keys).agg(*[_merged(n).alias(n) for n in names])


def _merged(name: str) -> Column:
    def having(value: str) -> Column:
        return F.when(F.col(value).isNotNull(), F.col(BLOCK))

    if name in _FIRST:
        return F.min_by(name, having(name))
    if name in _LAST:
        return F.max_by(name, having(name))
    if name in _PREVIOUS:
        return F.max_by(name, having(_PREVIOUS[name]))
    if name in _LEAST:
        return F.min(name)
    return F.max(name) if name in _MOST else F.sum(name)


def replaced(blocks: DataFrame, fresh: DataFrame, touched: DataFrame) -> DataFrame:
    """The blocks with those that ``touched`` names replaced by fresh ones."""
    return blocks.join(touched.select(*BLOCK_KEYS).distinct(), list(BLOCK_KEYS), "left_anti").unionByName(fresh)
