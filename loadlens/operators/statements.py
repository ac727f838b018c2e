"""Reports on statements: identity, cost per execution, plan changes, text search."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadlens.functions import day_of, half_up, like, per_exec, whole_second
from loadlens.operators.common import (
    Tables,
    broadcast_if_small,
    only,
    settled,
    window_of,
)
from loadlens.sources.store import SNAP_KEYS

# Report column -> counter. Times are kept in microseconds, the rest are plain counts.
TIMES = {
    "ela": "elapsed_time_delta",
    "cpu": "cpu_time_delta",
    "io": "iowait_delta",
    "cc": "ccwait_delta",
    "app": "apwait_delta",
    "plsql": "plsexec_time_delta",
    "java": "javexec_time_delta",
}
COUNTS = {
    "disk": "disk_reads_delta",
    "lio": "buffer_gets_delta",
    "r": "rows_processed_delta",
    "pc": "parse_calls_delta",
    "px": "px_servers_execs_delta",
}


def _totals() -> list[Column]:
    counters = {"e": "executions_delta", **TIMES, **COUNTS}
    return [F.sum(counter).alias(name) for name, counter in counters.items()]


def _per_exec_columns(unit: int) -> list[Column]:
    e = F.col("e")
    return [
        e,
        *[per_exec(F.col(n), e, scale=unit, digits=4).alias(n) for n in TIMES],
        *[per_exec(F.col(n), e).alias(n) for n in COUNTS],
    ]


def _total_elapsed() -> Column:
    return F.col("ela") * F.when(F.col("e").isNotNull(), F.greatest("e", F.lit(1)))


def sql_common_info(tables: Tables, *, sql_ids: Iterable[str] | None = None) -> DataFrame:
    """Command name, text and number of distinct plans ever loaded for each statement."""
    plans = (
        only(tables["sqlstat"], "sql_id", sql_ids)
        .groupBy("sql_id")
        .agg(F.countDistinct("plan_hash_value").alias("plan_loaded"))
    )
    return (
        only(tables["sqltext"], "sql_id", sql_ids)
        .join(broadcast_if_small(tables["command_name"]), "command_type")
        .join(plans, "sql_id", "left")
        .select(
            "command_name",
            "sql_id",
            F.coalesce("plan_loaded", F.lit(0).cast("bigint")).alias("plan_loaded"),
            "sql_text",
        )
    )


def sql_text(
    tables: Tables, *, sql_ids: Iterable[str] | None = None, all_columns: bool = False
) -> DataFrame:
    """Id and text of each statement, or every column its table has."""
    found = only(tables["sqltext"], "sql_id", sql_ids)
    return found if all_columns else found.select("sql_id", "sql_text")


def sql_stats_daily(
    tables: Tables,
    *,
    btime: datetime | None,
    etime: datetime | None,
    sql_ids: Iterable[str] | None = None,
    unit: int = 1_000_000,
) -> DataFrame:
    """Per day, statement and plan: executions and cost per execution (times in ``unit`` us)."""
    window = window_of(tables["snapshot"], btime, etime, "begin_interval_time")
    return (
        window.join(only(tables["sqlstat"], "sql_id", sql_ids))
        .groupBy(
            F.col("sql_id").alias("sqlid"),
            F.col("plan_hash_value").alias("phv"),
            day_of(F.col("begin_interval_time")).alias("tl"),
        )
        .agg(*_totals())
        .select("sqlid", "phv", "tl", *_per_exec_columns(unit))
        .orderBy(F.desc("tl"), _total_elapsed().desc_nulls_last(), "sqlid", "phv")
    )


def _plan_cost(
    tables: Tables,
    btime: datetime | None,
    etime: datetime | None,
    sql_ids: Iterable[str] | None,
    *extra: Column,
    planned_only: bool = False,
) -> DataFrame:
    """Executions and average elapsed seconds per statement and plan, in one pass of the fact."""
    stats = only(tables["sqlstat"], "sql_id", sql_ids)
    if planned_only:
        stats = stats.where(F.col("plan_hash_value") != 0)
    window = window_of(tables["snapshot"], btime, etime, "begin_interval_time")
    return (
        window.join(stats)
        .groupBy("sql_id", "plan_hash_value")
        .agg(
            F.sum("executions_delta").alias("e"),
            F.sum("elapsed_time_delta").alias("elapsed"),
            *extra,
        )
        .withColumn("ela", per_exec(F.col("elapsed"), F.col("e"), scale=1_000_000, digits=4))
        .drop("elapsed")
    )


def plan_stats(
    tables: Tables,
    *,
    btime: datetime | None,
    etime: datetime | None,
    sql_ids: Iterable[str] | None = None,
) -> DataFrame:
    """Executions and average elapsed seconds per statement and plan over the window."""
    return _plan_cost(tables, btime, etime, sql_ids)


def multi_plan_queries(
    tables: Tables, *, btime: datetime | None, etime: datetime | None
) -> DataFrame:
    """Statements that ran with more than one plan, and how far apart their plans are.

    The fact is reduced to one row per statement and plan; everything else is a second, small
    aggregation of that, so the fact is read once and never joined to itself.
    """
    per_plan = _plan_cost(
        tables,
        btime,
        etime,
        None,
        F.max("begin_interval_time").alias("last_begin"),
        planned_only=True,
    )
    # ten-thousandths, so that the percentage is a quotient of whole numbers
    low, high = (F.round(F.col(c) * 10_000).cast("bigint") for c in ("min_elapsed", "max_elapsed"))
    percent = F.when(F.col("min_elapsed") == 0, F.lit(0).cast("bigint")).otherwise(
        half_up((high - low) * 100, F.abs(low))
    )
    return (
        per_plan.groupBy("sql_id")
        .agg(
            F.count("plan_hash_value").alias("loaded_plans"),
            whole_second(F.max("last_begin")).alias("last_load_time"),
            F.min("ela").alias("min_elapsed"),
            F.max("ela").alias("max_elapsed"),
        )
        .where(F.col("loaded_plans") > 1)
        .withColumn("percent", percent)
        .orderBy(F.col("percent").desc_nulls_first(), "sql_id")
    )


def queries_by_text(
    tables: Tables, *, patterns: Iterable[str], literal: bool = False
) -> DataFrame:
    """Statements whose upper-cased text contains a pattern, with the cost of their latest day.

    Patterns are LIKE patterns (``_`` matches any character) unless ``literal``. Times are in
    milliseconds. Statements without statistics stay in the result with empty figures. The texts are
    searched once; only ids go through the statistics, and the text meets the reduced rows last.
    """
    text = F.upper("sql_text")
    found = F.lit(False)
    for p in patterns:
        found = found | (text.contains(p) if literal else like(text, f"%{p}%"))
    queries = settled(
        tables["sqltext"]
        .where(found)
        .select(F.col("sql_id").alias("sqlid"), "sql_text")
    )
    ids = broadcast_if_small(queries.select(F.col("sqlid").alias("sql_id")))
    begins = tables["snapshot"].select(*SNAP_KEYS, "begin_interval_time")
    daily = (
        tables["sqlstat"]
        .join(ids, "sql_id", "left_semi")
        .join(broadcast_if_small(begins), SNAP_KEYS, "left")
        .groupBy("sql_id", day_of(F.col("begin_interval_time")).alias("tl"), "module")
        .agg(*_totals())
    )
    # ranked after the reduction to days; Spark also drops older days before the exchange
    latest = Window.partitionBy("sql_id").orderBy(F.col("tl").desc_nulls_first())
    last_day = daily.withColumn("drnk", F.dense_rank().over(latest)).where("drnk = 1")
    return (
        queries.join(last_day.withColumnRenamed("sql_id", "sqlid"), "sqlid", "left")
        .select("sqlid", "tl", *_per_exec_columns(1_000), "module", "sql_text")
        .orderBy(_total_elapsed().desc_nulls_last(), "sqlid", "module")
    )

