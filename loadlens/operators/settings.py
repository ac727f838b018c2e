"""Reports on parameters and daily system statistics."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadlens.functions import day_of, half_up, like, ts_lit
from loadlens.operators.common import Tables, measured, only
from loadlens.sources.store import SNAP_KEYS


def parameter_values(
    tables: Tables,
    *,
    names: Iterable[str] | None = None,
    pattern: str | None = None,
    escape: str | None = None,
) -> DataFrame:
    """Session and instance value of the parameters with the given names or a name like a pattern."""
    params = only(tables["param_def"], "name", names)
    if pattern is not None:
        params = params.where(like(F.col("name"), pattern, escape))
    own = tables["param_session"].select("indx", F.col("value").alias("session_value"))
    shared_value = tables["param_instance"].select("indx", F.col("value").alias("instance_value"))
    return (
        params.join(own, "indx")
        .join(shared_value, "indx")
        .orderBy(F.col("name").asc_nulls_last(), "indx")
        .select(
            F.col("name").alias("parameter"), "description", "session_value", "instance_value"
        )
    )


def daily_stat_sum(
    tables: Tables, *, stat_name: str, day: datetime | None = None, scale: int = 1
) -> DataFrame:
    """Sum of one statistic over the snapshots inside a day, divided by ``scale`` and rounded.

    A snapshot counts when it began after the instance started and lies inside the day: from
    midnight on and ended before the next midnight. Without ``day`` every day is reported.
    """
    date_calc = day_of(F.col("begin_interval_time"))
    midnight = next_day = None
    snaps = tables["snapshot"].where(F.col("begin_interval_time") > F.col("startup_time"))
    if day is None:
        snaps = snaps.where(F.col("end_interval_time") < date_calc + F.expr("interval 1 day"))
    else:
        midnight = day.replace(hour=0, minute=0, second=0, microsecond=0)
        next_day = midnight + timedelta(days=1)
        snaps = snaps.where(F.col("begin_interval_time") >= ts_lit(midnight)).where(
            F.col("end_interval_time") < ts_lit(next_day)
        )
    window = measured(snaps.select(*SNAP_KEYS, date_calc.alias("date_calc")), midnight, next_day)
    return (
        window.join(tables["sysstat"].where(F.lower("stat_name") == stat_name))
        .groupBy("date_calc", "stat_name")
        .agg(half_up(F.sum("value"), scale=scale).alias("value"))
    )


def daily_logons(tables: Tables, *, day: datetime | None = None) -> DataFrame:
    """Sessions logged on, summed over the snapshots of a day."""
    return daily_stat_sum(tables, stat_name="logons current", day=day).withColumnRenamed(
        "value", "number_of_logons"
    )


def daily_connect_time(tables: Tables, *, day: datetime | None = None) -> DataFrame:
    """Seconds spent on connecting sessions in a day."""
    return daily_stat_sum(
        tables, stat_name="session connect time", day=day, scale=1_000_000
    ).withColumnRenamed("value", "session_connect_time")
