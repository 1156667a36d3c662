"""Time parameters as literals."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def instant(ts: datetime) -> Column:
    """A timestamp literal; a time without zone is read in the session's time zone."""
    return F.lit(ts.isoformat(sep=" ")).cast("timestamp")
