"""Merge of a batch into a stored table on its natural key."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from altcredit.functions.times import instant


def last_per_key(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], drop_order: bool = True
) -> DataFrame:
    """The last row per key in ``order``. Partial aggregation: a much-repeated key stays cheap."""
    values = [c for c in rows.columns if c not in keys and (c not in order or not drop_order)]
    row = F.max_by(F.struct(*values), F.struct(*order)).alias("_row")
    return rows.groupBy(*keys).agg(row).select(*keys, "_row.*")


def merge(
    stored: DataFrame, batch: DataFrame, keys: Sequence[str], run_ts: datetime
) -> DataFrame:
    """All rows of both sides, the batch winning on equal keys.

    ``created_at`` of a stored row is kept; ``updated_at`` changes only where the batch has the
    key. Both sides are unique on the key, so the join cannot skew.
    """
    now = instant(run_ts)
    names = [c for c in stored.columns if c not in keys]
    new = batch.select(*keys, *[c for c in names if c in batch.columns], F.lit(True).alias("_new"))
    joined = stored.alias("old").join(new.alias("new"), list(keys), "full_outer")
    incoming = F.coalesce(F.col("new._new"), F.lit(False))

    def merged(name: str) -> Column:
        if name == "created_at":
            return F.coalesce("old.created_at", now)
        if name == "updated_at":
            return F.when(incoming, now).otherwise(F.col("old.updated_at"))
        return F.when(incoming, F.col(f"new.{name}")).otherwise(F.col(f"old.{name}"))

    return joined.select(*keys, *[merged(c).alias(c) for c in names]).select(*stored.columns)
