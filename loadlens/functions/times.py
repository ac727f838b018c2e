"""Time helpers. Every report runs in a UTC session; "now" is always a parameter."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DayTimeIntervalType


def ts_lit(at: datetime) -> Column:
    """A timestamp literal read in the session time zone, not in the driver's."""
    return F.lit(at.isoformat(sep=" ")).cast("timestamp")


def day_of(ts: Column) -> Column:
    return F.date_trunc("day", ts)


def whole_second(ts: Column) -> Column:
    return F.date_trunc("second", ts)


def look_back(as_of: datetime, *, days: int = 30, ahead: int = 0) -> tuple[datetime, datetime]:
    """The default report window: ``days`` whole days before ``as_of``, to ``ahead`` days after it."""
    midnight = as_of.replace(hour=0, minute=0, second=0, microsecond=0)
    return midnight - timedelta(days=days), as_of + timedelta(days=ahead)


def seconds_of(span: Column) -> Column:
    """Length of a day-time interval in seconds."""
    return F.unix_micros(F.timestamp_seconds(F.lit(0)) + span) / F.lit(1e6)


def to_seconds(df: DataFrame) -> DataFrame:
    """The same rows with every interval column turned into seconds."""
    return df.select(
        *[
            seconds_of(F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, DayTimeIntervalType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )
