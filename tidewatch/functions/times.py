"""Moments and durations that do not depend on the session time zone."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def moment(df: DataFrame, column: str, value: datetime) -> Column:
    """A literal of the column's own timestamp type, so that comparisons reach the scan."""
    return F.lit(value.isoformat(sep=" ")).cast(df.schema[column].dataType)


def seconds_between(start: str, end: str) -> Column:
    """Elapsed seconds, to the microsecond, of two timestamp columns, in any session time zone."""
    elapsed = F.col(end) - F.col(start)
    parts = {"DAY": 86_400, "HOUR": 3_600, "MINUTE": 60, "SECOND": 1}
    return sum(F.extract(F.lit(p), elapsed).cast("decimal(20,6)") * n for p, n in parts.items()).cast("double")
