"""Reports on executions, sessions and long operations."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadlens.functions import count_set_flags, half_up, range_text, text_cat, whole_second
from loadlens.operators.common import Tables, broadcast_if_small, only, window_of
from loadlens.sources.store import SNAP_KEYS

_EXECUTION = [
    "sql_id",
    "sql_plan_hash_value",
    "sql_exec_id",
    "sql_exec_start",
    "session_id",
    "session_serial",
]
_FLAGS = {
    "parse": "in_parse",
    "hard_parse": "in_hard_parse",
    "sql": "in_sql_execution",
    "plsql": "in_plsql_execution",
    "java": "in_java_execution",
    "cursor_close": "in_cursor_close",
}
_MIB = 1024 * 1024


def _measure(samples: DataFrame, keys: list[str]) -> DataFrame:
    return samples.groupBy(*keys).agg(
        F.min("snap_id").alias("first_snap"),
        F.max("snap_id").alias("last_snap"),
        F.max("sample_time").alias("last_sample"),
        F.sum("tm_delta_db_time").alias("db"),
        F.sum("tm_delta_cpu_time").alias("cpu"),
        F.sum("delta_read_io_bytes").alias("rd"),
        F.sum("delta_write_io_bytes").alias("wr"),
        F.count(F.lit(1)).alias("wait_count"),
        *[count_set_flags(flag).alias(name) for name, flag in _FLAGS.items()],
    )


def _merge(measured: DataFrame, keys: list[str]) -> DataFrame:
    sums = ["db", "cpu", "rd", "wr", "wait_count", *_FLAGS]
    return measured.groupBy(*keys).agg(
        F.min("first_snap").alias("first_snap"),
        F.max("last_snap").alias("last_snap"),
        F.max("last_sample").alias("last_sample"),
        *[F.sum(name).alias(name) for name in sums],
    )


def sql_executions(
    tables: Tables,
    *,
    btime: datetime | None,
    etime: datetime | None,
    sql_ids: Iterable[str] | None = None,
) -> DataFrame:
    """One row per sampled execution and session: span, cost, IO and phase counts.

    Raw samples are never shuffled: with few snapshots in the window they are reduced right after a
    broadcast join, and with many they are reduced per snapshot before the join.
    """
    window = window_of(tables["snapshot"], btime, etime)
    samples = only(tables["ash"], "sql_id", sql_ids)
    if window.few:
        executions = _measure(window.join(samples), _EXECUTION)
    else:
        per_snapshot = _measure(window.keep(samples), [*SNAP_KEYS, *_EXECUTION])
        executions = _merge(window.join(per_snapshot), _EXECUTION)
    return executions.select(
        "sql_id",
        F.col("sql_plan_hash_value").alias("plan_hash_value"),
        "sql_exec_id",
        text_cat(F.col("session_id"), ",", F.col("session_serial")).alias("sid_serial"),
        range_text(F.col("first_snap"), F.col("last_snap"), " - ").alias("snap_range"),
        "sql_exec_start",
        whole_second(F.col("last_sample")).alias("sql_exec_stop"),
        half_up(F.col("db"), scale=1_000_000, digits=2).alias("db_time"),
        half_up(F.col("cpu"), scale=1_000_000, digits=2).alias("cpu_time"),
        half_up(F.col("rd"), scale=_MIB).alias("read"),
        half_up(F.col("wr"), scale=_MIB).alias("write"),
        "wait_count",
        *_FLAGS,
    ).orderBy(
        F.col("sql_exec_start").desc_nulls_last(),
        "sql_id",
        "plan_hash_value",
        "sql_exec_id",
        "sid_serial",
    )


def plan_stats_ash(
    tables: Tables,
    *,
    btime: datetime | None,
    etime: datetime | None,
    sql_ids: Iterable[str] | None = None,
) -> DataFrame:
    """Spread of sampled database time (ms) per execution, for each statement and plan.

    Samples are summed per snapshot and execution before they meet the statistics rows, so a
    statement that holds a large share of the samples is spread over its snapshots and executions.
    """
    key = [*SNAP_KEYS, "sql_id", "plan_hash_value"]
    window = window_of(tables["snapshot"], btime, etime)
    stats = window.join(only(tables["sqlstat"], "sql_id", sql_ids))
    samples = (
        window.keep(only(tables["ash"], "sql_id", sql_ids))
        .withColumnRenamed("sql_plan_hash_value", "plan_hash_value")
        .groupBy(*key, "sql_exec_id", "sql_exec_start")
        .agg(F.sum("tm_delta_db_time").alias("db"))
    )
    per_execution = (
        samples.join(stats.select(*key), key)
        .groupBy("sql_id", "plan_hash_value", "sql_exec_id", "sql_exec_start")
        .agg(F.sum("db").alias("db_time"))
    )
    db_time = F.col("db_time")
    # the spread of a single execution is 0
    spread = F.when(F.count(db_time) == 1, F.lit(0.0)).otherwise(F.stddev_samp(db_time))
    return (
        per_execution.groupBy("sql_id", "plan_hash_value")
        .agg(
            F.sum(db_time).alias("total"),
            F.count(db_time).alias("known"),
            F.round(spread / 1e3).cast("bigint").alias("stddev_ms"),
            F.min(db_time).alias("low"),
            F.max(db_time).alias("high"),
            F.count(F.lit(1)).alias("sqlexec"),
        )
        .select(
            "sql_id",
            "plan_hash_value",
            half_up(F.col("total"), F.col("known"), scale=1_000).alias("avg_ms"),
            "stddev_ms",
            half_up(F.col("low"), scale=1_000).alias("min_ms"),
            half_up(F.col("high"), scale=1_000).alias("max_ms"),
            "sqlexec",
        )
    )


def monitor_executions(
    tables: Tables, *, sql_ids: Iterable[str] | None = None, with_text: bool = False
) -> DataFrame:
    """One row per monitored execution, optionally with the statement text of its plan."""
    rows = (
        only(tables["plan_monitor"], "sql_id", sql_ids)
        .where("plan_line_id = 0")
        .select(
            "status",
            "sid",
            "sql_exec_id",
            "sql_exec_start",
            "sql_id",
            "sql_plan_hash_value",
            "output_rows",
            (F.col("last_refresh_time") - F.col("sql_exec_start")).alias("ela"),
        )
    )
    if with_text:  # ``sql_area`` has one row per statement and plan
        texts = only(tables["sql_area"], "sql_id", sql_ids).select(
            "sql_id",
            F.col("plan_hash_value").alias("sql_plan_hash_value"),
            F.col("sql_fulltext").alias("sqltext"),
        )
        rows = rows.join(texts, ["sql_id", "sql_plan_hash_value"], "left").select(
            *rows.columns, "sqltext"
        )
    return rows.orderBy(
        F.col("sql_id").asc_nulls_last(),
        F.col("sql_exec_start").desc_nulls_first(),
        "sql_plan_hash_value",
        "sql_exec_id",
    )


def monitor_rows(
    tables: Tables,
    *,
    sql_ids: Iterable[str] | None = None,
    exec_ids: Iterable[int] | None = None,
) -> DataFrame:
    """All monitor columns of the plan lines of the given statements and executions."""
    return only(only(tables["plan_monitor"], "sql_id", sql_ids), "sql_exec_id", exec_ids)


def sessions_for_user(tables: Tables, *, os_user: str) -> DataFrame:
    """Progress text, then every session column; the table's own progress column is ``action_1``."""
    mine = tables["session"].where(F.col("osuser") == os_user)
    return mine.select(
        "action", *[F.col(c).alias("action_1") if c == "action" else F.col(c) for c in mine.columns]
    )


def long_operations(tables: Tables, *, opname: str) -> DataFrame:
    return tables["longop"].where(F.col("opname") == opname)


def long_operations_running(tables: Tables, *, opname: str) -> DataFrame:
    """Unfinished long operations of sessions now working under a statement of ``opname``.

    Activity is reduced to distinct rows before it is joined, so a session or statement sampled many
    times reaches the join once.
    """
    top = long_operations(tables, opname=opname).select("sql_id").distinct()
    top = broadcast_if_small(top.withColumnRenamed("sql_id", "top_level_sql_id"))
    working = (
        tables["active_now"]
        .select("session_id", "session_serial", "sql_id", "top_level_sql_id")
        .distinct()
        .join(top, "top_level_sql_id", "left_semi")
        .select(F.col("session_id").alias("sid"), F.col("session_serial").alias("serial_no"), "sql_id")
    )
    unfinished = tables["longop"].where("time_remaining > 0")
    return unfinished.join(working, ["sid", "serial_no", "sql_id"], "left_semi").select(
        *unfinished.columns
    )
