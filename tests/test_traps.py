"""Meaning of single rows: rounding, NULLs, empty text, borders, several instances."""

from __future__ import annotations

from datetime import date, datetime, timedelta
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from frames import DAY, at, frame, row_set, rows, snap
from loadlens import operators as op
from loadlens import plans
from loadlens.functions import (
    grouped_text,
    half_up,
    like,
    look_back,
    number_text,
    per_exec,
    range_text,
    text_cat,
    to_seconds,
)
from loadlens.sources import read_telemetry, write_telemetry

HOUR = timedelta(hours=1)
OPEN = {"btime": None, "etime": None}


def exact(num, den, scale, digits):
    quotient = Decimal(num) / Decimal(den) / Decimal(scale)
    return quotient.quantize(Decimal(1).scaleb(-digits), rounding=ROUND_HALF_UP)


@pytest.mark.parametrize("scale,digits", [(1, 0), (1_000_000, 4), (1_000, 4), (1_048_576, 3), (3, 2)])
def test_rounding_is_exact_on_ties_and_signs(spark, scale, digits):
    pairs = [(n, d) for n in (-7, -5, 0, 5, 25, 12_345, 210_212_500, 210_212_499) for d in (1, 2, 3, 8)]
    df = spark.createDataFrame(pairs, "num bigint, den bigint")
    got = df.select("num", "den", half_up(F.col("num"), F.col("den"), scale=scale, digits=digits).alias("v"))
    for num, den, value in rows(got):
        assert Decimal(str(value)) == exact(num, den, scale, digits), (num, den)


def test_rounding_handles_zero_and_null(spark):
    df = spark.createDataFrame([(5, 0), (None, 2), (5, None), (-7, -2)], "num bigint, den bigint")
    assert rows(df.select(half_up(F.col("num"), F.col("den")).alias("v"))) == [
        (None,),
        (None,),
        (None,),
        (4,),
    ]


def test_cost_per_execution_counts_at_least_one_and_keeps_null(spark):
    df = spark.createDataFrame([(10, 0), (10, 4), (10, None), (None, 4)], "t bigint, e bigint")
    assert rows(df.select(per_exec(F.col("t"), F.col("e"), digits=4).alias("v"))) == [
        (10.0,),
        (2.5,),
        (None,),
        (None,),
    ]


def test_missing_text_is_empty(spark):
    df = spark.createDataFrame([(None, 1), (2, None)], "a bigint, b bigint")
    assert rows(df.select(text_cat("x", F.col("a"), "y", F.col("b")).alias("v"))) == [
        ("xy1",),
        ("x2y",),
    ]
    assert rows(df.select(range_text(F.col("a"), F.col("a")).alias("v"))) == [("-",), ("2-2",)]


def test_numbers_as_text(spark):
    df = spark.createDataFrame(
        [(0,), (5,), (50,), (100,), (10_000,), (1_234_567_89,), (-250,), (None,)], "c bigint"
    )
    assert rows(df.select(number_text(F.col("c")).alias("v"))) == [
        ("0",),
        ("0.05",),
        ("0.5",),
        ("1",),
        ("100",),
        ("1234567.89",),
        ("-2.5",),
        (None,),
    ]
    assert rows(df.select(grouped_text(F.col("c")).alias("v")))[:6] == [
        ("0.00",),
        ("0.05",),
        ("0.50",),
        ("1.00",),
        ("100.00",),
        ("1 234 567.89",),
    ]


def test_like_has_an_escape_only_when_given(spark):
    df = spark.createDataFrame([("a_b",), ("aXb",), (r"a\b",)], "s string")
    assert rows(df.where(like(F.col("s"), "a_b"))) == [("a_b",), ("aXb",), (r"a\b",)]
    assert rows(df.where(like(F.col("s"), r"a\_b", "\\"))) == [("a_b",)]
    assert rows(df.where(like(F.col("s"), r"a\b"))) == [(r"a\b",)]


def test_default_window():
    assert look_back(datetime(2024, 1, 31, 15, 30)) == (
        datetime(2024, 1, 1),
        datetime(2024, 1, 31, 15, 30),
    )
    assert look_back(datetime(2024, 1, 31), ahead=1)[1] == datetime(2024, 2, 1)


def stats(spark, *stat_rows, snaps=None):
    snaps = snaps or [snap(1, DAY), snap(2, DAY + HOUR), snap(30, DAY + timedelta(days=1))]
    return {"snapshot": frame(spark, "snapshot", snaps), "sqlstat": frame(spark, "sqlstat", stat_rows)}


def stat(snap_id, sql_id, plan, executions, elapsed, instance=1, dbid=1, module=None):
    return {
        **at(snap_id, instance, dbid),
        "sql_id": sql_id,
        "plan_hash_value": plan,
        "executions_delta": executions,
        "elapsed_time_delta": elapsed,
        "module": module,
    }


def test_window_borders_are_inclusive(spark):
    t = stats(spark, stat(1, "a", 1, 1, 10), stat(2, "a", 1, 1, 10), stat(30, "a", 1, 1, 10))
    got = op.plan_stats(t, btime=DAY, etime=DAY + HOUR)
    assert rows(got, "e") == [(2,)]


def test_empty_window_gives_no_rows(spark):
    t = stats(spark, stat(1, "a", 1, 1, 10))
    nothing = {"btime": datetime(2030, 1, 1), "etime": datetime(2030, 1, 2)}
    assert rows(op.plan_stats(t, **nothing)) == []
    assert rows(op.multi_plan_queries(t, **nothing)) == []
    assert rows(op.sql_stats_daily(t, **nothing)) == []


def test_several_instances_and_databases_do_not_multiply(spark):
    snaps = [snap(1, DAY, instance=i, dbid=d) for i in (1, 2) for d in (1, 2)]
    t = stats(spark, *[stat(1, "a", 5, 1, 10, i, d) for i in (1, 2) for d in (1, 2)], snaps=snaps)
    assert rows(op.plan_stats(t, **OPEN), "e") == [(4,)]


def test_plan_change_report(spark):
    t = stats(
        spark,
        stat(1, "a", 0, 1, 99_000_000),  # plan 0 does not count
        stat(1, "a", 1, 2, 4_000_000),
        stat(30, "a", 2, 1, 6_500_000),
        stat(1, "b", 1, 1, 10),
        stat(1, "z", 1, 1, 0),
        stat(1, "z", 2, 1, 5_000_000),
    )
    assert row_set(op.multi_plan_queries(t, **OPEN)) == [
        ("a", 2, DAY + timedelta(days=1), 2.0, 6.5, 225),
        ("z", 2, DAY, 0.0, 5.0, 0),
    ]


def test_daily_costs_are_sorted_by_day_then_total_elapsed(spark):
    t = stats(
        spark,
        stat(1, "a", 1, 10, 20_000_000),
        stat(2, "b", 1, 0, 50_000_000),
        stat(30, "a", 1, 3, 10_000_000),
        stat(30, "c", 1, None, None),
    )
    got = rows(op.sql_stats_daily(t, **OPEN), "sqlid", "tl", "e", "ela")
    assert got == [
        ("a", DAY + timedelta(days=1), 3, 3.3333),
        ("c", DAY + timedelta(days=1), None, None),
        ("b", DAY, 0, 50.0),
        ("a", DAY, 10, 2.0),
    ]


def test_statement_without_statistics_has_no_plans(spark):
    t = stats(spark, stat(1, "a", 1, 1, 1), stat(2, "a", 2, 1, 1), stat(2, "a", 2, 1, 1))
    t["sqltext"] = frame(
        spark,
        "sqltext",
        [{"sql_id": i, "command_type": c, "sql_text": "t"} for i, c in (("a", 3), ("b", 3), ("c", 9))],
    )
    t["command_name"] = frame(spark, "command_name", [{"command_type": 3, "command_name": "SELECT"}])
    assert row_set(op.sql_common_info(t)) == [("SELECT", "a", 2, "t"), ("SELECT", "b", 0, "t")]
    assert row_set(op.sql_common_info(t, sql_ids=["b"])) == [("SELECT", "b", 0, "t")]
    assert row_set(op.sql_text(t, sql_ids=["c"])) == [("c", "t")]


def test_text_search_keeps_latest_day_and_unknown_day_first(spark):
    t = stats(
        spark,
        stat(1, "a", 1, 1, 10_000, module="m"),
        stat(30, "a", 1, 2, 40_000, module="m"),
        stat(30, "a", 2, 2, 40_000, module="n"),
        stat(1, "u", 1, 1, 10_000, module="m"),
        stat(99, "u", 1, 1, 70_000, module="m"),  # no such snapshot
        stat(1, "x", 1, 1, 10_000),
    )
    texts = {"a": "select 1 from t_one", "u": "select T_ONE.x", "n": "from tXone", "x": "other"}
    t["sqltext"] = frame(
        spark, "sqltext", [{"sql_id": k, "command_type": 3, "sql_text": v} for k, v in texts.items()]
    )
    tomorrow = DAY + timedelta(days=1)
    want = [
        ("a", tomorrow, 2, 20.0, "m"),
        ("a", tomorrow, 2, 20.0, "n"),
        ("n", None, None, None, None),
        ("u", None, 1, 70.0, "m"),
    ]
    got = op.queries_by_text(t, patterns=["T_ONE"])
    assert row_set(got, "sqlid", "tl", "e", "ela", "module") == want
    literal = op.queries_by_text(t, patterns=["T_ONE"], literal=True)
    assert row_set(literal, "sqlid") == [("a",), ("a",), ("u",)]
    both = op.queries_by_text(t, patterns=["T_ONE", "FROM"])
    assert both.count() == 4


def test_found_text_is_searched_and_returned_in_full(spark):
    t = stats(spark)
    long_text = "x" * 5000 + " from needle"
    t["sqltext"] = frame(spark, "sqltext", [{"sql_id": "a", "command_type": 3, "sql_text": long_text}])
    ((text,),) = rows(op.queries_by_text(t, patterns=["NEEDLE"]), "sql_text")
    assert text == long_text


def sample(snap_id, second=0, **more):
    base = {
        **at(snap_id),
        "sample_time": DAY + timedelta(seconds=second, milliseconds=700),
        "session_id": 12,
        "session_serial": 3,
        "sql_id": "a",
        "sql_plan_hash_value": 1,
        "tm_delta_db_time": 1_000_000,
    }
    return {**base, **more}


def test_execution_report(spark):
    t = stats(spark, stat(1, "a", 1, 1, 1))
    t["ash"] = frame(
        spark,
        "ash",
        [
            sample(1, 5, sql_exec_id=7, sql_exec_start=DAY, in_parse="Y", in_hard_parse="N"),
            sample(2, 65, sql_exec_id=7, sql_exec_start=DAY, in_parse=None, delta_read_io_bytes=1572864),
            sample(1, 9, in_parse="N"),
        ],
    )
    got = rows(
        op.sql_executions(t, **OPEN),
        "sql_exec_id",
        "sid_serial",
        "snap_range",
        "sql_exec_stop",
        "db_time",
        "cpu_time",
        "read",
        "wait_count",
        "parse",
        "hard_parse",
    )
    assert got == [
        (7, "12,3", "1 - 2", DAY + timedelta(seconds=65), 2.0, None, 2, 2, 1, 0),
        (None, "12,3", "1 - 1", DAY + timedelta(seconds=9), 1.0, None, None, 1, 0, 0),
    ]


def test_spread_of_a_single_execution_is_zero(spark):
    t = stats(spark, stat(1, "a", 1, 1, 1), stat(1, "b", 1, 1, 1))
    runs = [(1, 2_000_000), (1, 2_000_000), (2, 1_000_500)]
    t["ash"] = frame(
        spark,
        "ash",
        [sample(1, sql_exec_id=i, sql_exec_start=DAY, tm_delta_db_time=v) for i, v in runs]
        + [sample(1, sql_id="b", sql_exec_id=1, tm_delta_db_time=1_500)],
    )
    assert row_set(op.plan_stats_ash(t, **OPEN)) == [
        ("a", 1, 2500, 2121, 1001, 4000, 2),
        ("b", 1, 2, 0, 2, 2, 1),
    ]


def test_monitored_execution_time_is_an_interval(spark):
    line = {
        "sql_id": "a",
        "sql_plan_hash_value": 1,
        "sql_exec_id": 5,
        "plan_line_id": 0,
        "sql_exec_start": DAY,
        "last_refresh_time": DAY + timedelta(seconds=90),
    }
    t = {
        "plan_monitor": frame(spark, "plan_monitor", [line, {**line, "plan_line_id": 1}]),
        "sql_area": frame(
            spark, "sql_area", [{"sql_id": "a", "plan_hash_value": 2, "sql_fulltext": "other plan"}]
        ),
    }
    got = op.monitor_executions(t, with_text=True)
    assert rows(got, "ela", "sqltext") == [(timedelta(seconds=90), None)]
    assert rows(to_seconds(got), "ela") == [(90.0,)]
    assert op.monitor_rows(t, exec_ids=[5]).count() == 2
    assert op.monitor_rows(t, exec_ids=[6]).count() == 0


def job(name, session, start, hours, cpu=1):
    return {
        "job_name": name,
        "session_id": session,
        "req_start_date": start,
        "run_duration": timedelta(hours=hours),
        "cpu_used": timedelta(seconds=cpu),
    }


def job_tables(spark, jobs, samples, snaps=None):
    snaps = snaps or [snap(i, DAY + i * HOUR) for i in range(1, 6)]
    return {
        "job_run": frame(spark, "job_run", jobs),
        "snapshot": frame(spark, "snapshot", snaps),
        "ash": frame(spark, "ash", samples),
        "parallel_task": frame(
            spark, "parallel_task", [{"job_prefix": "TASK$_1", "task_name": "load", "sql_stmt": "s"}]
        ),
    }


def test_job_groups(spark):
    t = job_tables(
        spark,
        [
            job("TASK$_1_1", "1,1", DAY + timedelta(milliseconds=900), 1, 4),
            job("TASK$_1_1", "1,1", DAY + HOUR, 3, 2),
            job("TASK$_1_2", "1,1", DAY + HOUR, 2, 2),
            job("TASK$_2_1", "1,1", DAY, 1),
            job("TASK$_2", "1,1", DAY, 9),
            job("XTASK$_2_1", "1,1", DAY, 9),
            job("TASK$_1_3", "1,1", DAY - timedelta(days=9), 9),
        ],
        [],
    )
    got = op.job_group_summary(t, as_of=DAY + timedelta(days=1), retention=timedelta(days=5))
    one, two, three = (timedelta(hours=h) for h in (1, 2, 3))
    cpu = [timedelta(seconds=s) for s in (1, 2, 4)]
    assert rows(got) == [
        (1, "TASK$_1", 2, DAY, one, three, cpu[1], cpu[2], "load", "s"),
        (1, "TASK$_2", 1, DAY, one, one, cpu[0], cpu[0], None, None),
    ]


def test_job_attribution_counts_idle_jobs_once(spark):
    start = DAY + HOUR + timedelta(minutes=10)  # in snapshot 1
    t = job_tables(
        spark,
        [
            job("TASK$_1_1", "12,3", start, 2),  # snapshots 1-3
            job("TASK$_1_2", "77,1", start, 1),  # no samples
            job("TASK$_1_3", "12,3", start + timedelta(days=9), 1),  # outside every snapshot
            job("TASK$_1_4", "12", start, 1),  # no serial
            job("TASK$_2_1", "12,3", start, 0.1),  # snapshot 1 only
        ],
        [
            sample(1, sql_exec_id=1, sql_exec_start=DAY),
            sample(2, sql_exec_id=1, sql_exec_start=DAY),
            sample(3, sql_exec_id=2),
            sample(3, sql_id=None),
            sample(4, sql_exec_id=9),  # after the job
            sample(2, session_serial=4),  # another session
        ],
    )
    columns = ["job_prefix", "sql_id", "range_snap", "unq_run", "rowcount", "db_time"]
    assert rows(op.job_sql_attribution(t, job_like="TASK$_%"), *columns) == [
        ("TASK$_1", None, "1-3", 0, 4, 1),
        ("TASK$_1", "a", "1-3", 2, 3, 3),
        ("TASK$_2", "a", "1-1", 1, 1, 1),
        (None, None, "1-3", 2, 8, 5),
    ]
    late = {"as_of": DAY + timedelta(days=1), "retention": timedelta(days=5)}
    got = op.job_sql_attribution_all(t, **late)
    assert rows(got, "job_prefix", "job_count", "sql_id", "rowcount", "db_time") == [
        ("TASK$_1", 3, "a", 3, 3),
        ("TASK$_1", 3, None, 4, 1),
        ("TASK$_2", 1, "a", 1, 1),
    ]


def test_equal_runs_each_count(spark):
    run = job("TASK$_1_1", "12,3", DAY + HOUR + timedelta(minutes=1), 0.1)
    t = job_tables(spark, [run, run, run], [sample(1), sample(1, 1)])
    got = op.job_sql_attribution(t, job_like="TASK$_1%")
    assert rows(got, "job_prefix", "rowcount", "db_time") == [("TASK$_1", 6, 6), (None, 6, 6)]


def test_job_attribution_without_jobs_has_no_total(spark):
    t = job_tables(spark, [], [sample(1)])
    assert rows(op.job_sql_attribution(t, job_like="TASK$_%")) == []


def test_time_on_a_snapshot_border_takes_the_lower_snapshot(spark):
    snaps = [snap(i, DAY + i * HOUR, instance=n) for i in (1, 2, 3) for n in (1, 2)]
    # one long snapshot that spans several hours, and a gap after it
    snaps.append(snap(9, DAY + 6 * HOUR, hours=5))
    times = {
        DAY + 2 * HOUR: 1,
        DAY + 2 * HOUR + timedelta(minutes=30): 2,
        DAY + 4 * HOUR: 3,
        DAY + 5 * HOUR: None,
        DAY + 8 * HOUR: 9,
        DAY + 11 * HOUR: 9,
        DAY + 11 * HOUR + timedelta(seconds=1): None,
    }
    runs = spark.createDataFrame(
        [(i, at_, DAY + 2 * HOUR) for i, at_ in enumerate(times)], "k int, a timestamp, b timestamp"
    )
    got = op.add_snaps(runs, frame(spark, "snapshot", snaps), [], start="a", stop="b")
    assert row_set(got, "k", "start_snap", "stop_snap") == [
        (i, want, 1) for i, want in enumerate(times.values())
    ]


def test_session_of_another_database_is_another_session(spark):
    run = {**job("TASK$_1_1", "12,3", DAY + HOUR + timedelta(minutes=1), 0.1)}
    t = job_tables(
        spark,
        [run],
        [sample(1), {**sample(8), "dbid": 2}],
        [snap(1, DAY + HOUR, dbid=1), snap(8, DAY + HOUR, dbid=2)],
    )
    t["job_run"] = t["job_run"].withColumn("dbid", F.lit(2))
    got = op.job_sql_attribution(t, job_like="TASK$_1%")
    assert rows(got, "job_prefix", "range_snap", "rowcount") == [
        ("TASK$_1", "8-8", 1),
        (None, "8-8", 1),
    ]


def index_tables(spark):
    idx = {
        "owner": "O",
        "table_owner": "T",
        "table_name": "TAB",
        "num_rows": 1000,
        "pct_free": 10,
        "uniqueness": "UNIQUE",
    }
    names = ["I1", "I2", "I3"]
    return {
        "idx": frame(spark, "idx", [{**idx, "index_name": n} for n in names]),
        "ind_column": frame(
            spark,
            "ind_column",
            [
                {"index_owner": "O", "index_name": "I1", "column_name": c} for c in ("A", "B", "C")
            ],
        ),
        "ind_stat": frame(
            spark, "ind_stat", [{"owner": "O", "index_name": n, "num_rows": 1000} for n in names]
        ),
        "col_stat": frame(
            spark,
            "col_stat",
            [
                {"owner": "T", "table_name": "TAB", "column_name": "A", "avg_col_len": 4, "num_nulls": 0},
                {"owner": "T", "table_name": "TAB", "column_name": "B", "avg_col_len": 6, "num_nulls": 500},
            ],
        ),
        "tbl": frame(
            spark,
            "tbl",
            [{"owner": "T", "table_name": "TAB", "last_analyzed": DAY, "monitoring": "YES"}],
        ),
        "index_segment": frame(
            spark,
            "index_segment",
            [
                {"owner": "O", "segment_name": "I1", "bytes": 40_000},
                {"owner": "O", "segment_name": "I2", "bytes": 1_048_576},
            ],
        ),
    }


def test_index_size_without_column_statistics_stays(spark):
    got = op.index_size_estimate(index_tables(spark))
    columns = ["index_name", "avg_row_len", "used_by_data_mb", "estimated_index_size_mb", "pct_used"]
    # (1000 * 12 + (1000 * 4 + 500 * 6) * 1.1) = 19700 bytes
    assert rows(got, *columns) == [("I1", 10, 0.01, 0.019, 49.25), ("I2", None, None, None, None)]
    assert op.index_size_estimate(index_tables(spark), owner="X").count() == 0
    assert rows(op.index_size_estimate(index_tables(spark), owner="O", indexes=["I2"]), "index_name") == [
        ("I2",)
    ]


def test_partition_rows_of_index_statistics_do_not_multiply(spark, tmp_path):
    t = index_tables(spark)
    whole = t["ind_stat"]
    t["ind_stat"] = whole.unionByName(whole.withColumn("partition_name", F.lit("P1")))
    write_telemetry(t, str(tmp_path))
    kept = read_telemetry(spark, str(tmp_path), t)
    assert rows(op.index_size_estimate(kept), "avg_row_len")[0] == (10,)


def test_counters_near_the_end_of_bigint(spark):
    t = usage_tables(spark, inserts=2**62, modified_at=DAY + timedelta(days=100))
    want = (2 * (2**62 + 25) + 144_000) // (2 * 144_000)
    assert ("I1", want) in rows(op.index_usage(t), "index_name", "row_modified_per_minute")


def usage_tables(spark, modified_at=DAY + timedelta(minutes=10), **more):
    change = {
        "table_owner": "T",
        "table_name": "TAB",
        "modified_at": modified_at,
        "inserts": 1200,
        "updates": 25,
        "deletes": 0,
        **more,
    }
    return {
        **index_tables(spark),
        "index_usage": frame(
            spark, "index_usage", [{"owner": "O", "name": "I1", "last_used": DAY + timedelta(days=9)}]
        ),
        "object_usage": frame(
            spark,
            "object_usage",
            [
                {
                    "index_name": "I1",
                    "table_name": "TAB",
                    "monitoring": "YES",
                    "used": "YES",
                    "start_monitoring": "01/31/2024 23:59:58",
                }
            ],
        ),
        "tab_modification": frame(spark, "tab_modification", [change]),
        "constraint_def": frame(
            spark, "constraint_def", [{"index_owner": "O", "index_name": "I2", "constraint_type": "P"}]
        ),
        "plan_line": frame(spark, "plan_line", [{"object_owner": "O", "object_name": "I1"}]),
        "index_usage_info": frame(spark, "index_usage_info", [{"index_stats_enabled": 1}]),
    }


def test_index_usage(spark):
    columns = [
        "index_name",
        "constraint_type",
        "index_total_mb",
        "start_index_monitoring",
        "row_modified_per_minute",
    ]
    assert rows(op.index_usage(usage_tables(spark)), *columns) == [
        ("I2", "P", 1.0, None, 123),
        ("I1", None, 0.038, datetime(2024, 1, 31, 23, 59, 58), 123),
    ]


def test_change_rate_without_time_or_for_a_partition_is_null(spark):
    for t in (usage_tables(spark, modified_at=DAY), usage_tables(spark, partition_name="P1")):
        assert {r for (r,) in rows(op.index_usage(t), "row_modified_per_minute")} == {None}


def test_index_filters(spark):
    t = usage_tables(spark)
    assert rows(op.index_usage(t, not_in_plans=True), "index_name") == [("I2",)]
    t["plan_line_hist"] = frame(spark, "plan_line", [{"object_owner": "O", "object_name": "I2"}])
    assert rows(op.index_usage(t, not_in_plans=True), "index_name") == []
    as_of = DAY + timedelta(days=10)
    unused = op.index_usage(t, unused_for=timedelta(days=2), as_of=as_of)
    assert rows(unused, "index_name") == [("I2",)]
    assert op.index_usage(t, unused_for=timedelta(hours=1), as_of=as_of).count() == 2
    assert op.index_usage(t, table_name="OTHER").count() == 0
    with pytest.raises(ValueError):
        op.index_usage(t, unused_for=timedelta(days=2))


def monitor_line(step, **more):
    base = {
        "sql_id": "a",
        "sql_plan_hash_value": 1,
        "sql_exec_id": 5,
        "plan_line_id": step,
        "plan_depth": step,
        "plan_operation": f"OP{step}",
        "first_refresh_time": DAY,
        "last_refresh_time": DAY + timedelta(seconds=3),
        "physical_read_requests": 2,
        "physical_write_requests": 3,
    }
    return {**base, **more}


def test_printed_monitor_report(spark):
    lines = [
        monitor_line(0, plan_cost=7, plan_cardinality=1, plan_bytes=9),
        monitor_line(1, plan_options="FULL", plan_object_name="TAB", plan_object_owner="O"),
        monitor_line(2, plan_object_name="I", plan_object_type="INDEX (UNIQUE)"),
    ]
    other = monitor_line(0, sql_id="b")
    totals = {
        "sql_id": "a",
        "plan_hash_value": 1,
        "delta_execution_count": 2,
        "delta_elapsed_time": 1_234_567_890_000,
        "delta_cpu_time": 5_000,
        "delta_disk_reads": 4,
    }
    t = {
        "plan_monitor": frame(spark, "plan_monitor", [*lines, other]),
        "sqlstats_delta": frame(spark, "sqlstats_delta", [totals]),
    }
    got = plans.plan_monitor_report(t, sql_id="a", plan_hash_value=1, sql_exec_id=5)
    assert rows(got, "id", "sqlplan") == [
        (None, "SQL_ID = a, phv = 1, eid = 5"),
        (
            None,
            "SQLSTAT: , e = 2, ela = 1 234 567.89, cpu = 0.01, io = , cc = , parse = , disk = 4, "
            "lio = , r = , px = ",
        ),
        (0, "OP0  (Cost=7 Card=1 Bytes=9)"),
        (1, "    OP1 (FULL) OF 'O.TAB'  (Cost= Card= Bytes=)"),
        (2, "        OP2 OF 'I' (UNIQUE)  (Cost= Card= Bytes=)"),
    ]
    assert rows(got, "a_time", "rwreq", "rwbyt")[0] == (timedelta(seconds=3), 5, None)
    without = plans.plan_monitor_report(t, sql_id="b")
    assert rows(without, "id", "sqlplan")[1] == (None, None)


def plan_tables(spark):
    steps = [
        {"id": 0, "depth": 0, "operation": "SELECT", "optimizer": "ALL_ROWS", "cost": 3},
        {"id": 1, "depth": 1, "operation": "TABLE ACCESS", "options": "FULL", "object_name": "T"},
        {"id": 2, "depth": 2, "operation": "INDEX"},
    ]
    cursor = {
        "sql_id": "a",
        "plan_hash_value": 1,
        "child_number": 0,
        "executions": 4,
        "elapsed_time": 1_500_000,
        "cpu_time": 2_000_000,
        "disk_reads": 8,
    }
    return {
        "plan_line": frame(
            spark, "plan_line", [{"sql_id": "a", "plan_hash_value": 1, **s} for s in steps]
        ),
        "sql_area": frame(spark, "sql_area", [cursor]),
        "plan_monitor": frame(
            spark,
            "plan_monitor",
            [monitor_line(0, starts=1), monitor_line(1, starts=6), monitor_line(1, starts=9, sql_exec_id=8)],
        ),
    }


def test_printed_plan_tree(spark):
    got = plans.plan_tree(plan_tables(spark))
    assert rows(got, "id", "sqlplan") == [
        (None, "SQL_ID = a, hv = 1, cn = 0, e = 4, ela = 1.5, cpu = 2, io = , disk = 8, lio = , r = "),
        (0, "SELECT  Optimizer=ALL_ROWS  (Cost=3 Card= Bytes=)"),
        (1, "    TABLE ACCESS (FULL) OF 'T'  (Cost= Card= Bytes=)"),
        (2, "        INDEX  (Cost= Card= Bytes=)"),
    ]
    assert plans.plan_tree(plan_tables(spark), child_number=1).count() == 0


def test_printed_plan_tree_keeps_steps_without_actuals(spark):
    t = plan_tables(spark)
    got = plans.plan_tree_with_actuals(t, exec_id=5)
    assert rows(got, "id", "sql_exec_id", "starts") == [
        (None, 5, 1),
        (0, 5, 1),
        (1, 5, 6),
        (2, None, None),
    ]
    every = plans.plan_tree_with_actuals(t)
    assert row_set(every, "id", "starts") == [(0, 1), (1, 6), (1, 9), (2, None), (None, 1)]


def test_plan_lines_from_a_named_table(spark):
    t = plan_tables(spark)
    t["plan_line_hist"] = t["plan_line"].where("id < 2")
    assert rows(plans.plan_lines(t), "operation") == [("SELECT",), (" TABLE ACCESS",), ("  INDEX",)]
    assert plans.plan_lines(t, source="plan_line_hist").count() == 2


def space(spark, name, **sizes):
    return frame(spark, name, [{"tablespace_name": k, "bytes": v} for k, v in sizes.items()])


def test_tablespaces(spark):
    mib = 1024 * 1024
    t = {
        "data_file": space(spark, "data_file", a=10 * mib, b=4 * mib, z=100),
        "temp_file": space(spark, "temp_file", t=2 * mib),
        "segment": space(spark, "segment", a=3 * mib + mib // 2, z=50),
        "free_space": space(spark, "free_space", a=mib + 5243),
    }
    # 3.5 MB are 4; the size of z rounds to nothing; b has no segments
    assert row_set(op.tablespace_usage(t)) == [("a", 4, 6, 10, 60), ("z", 0, 0, 0, None)]
    assert row_set(op.tablespace_free(t)) == [
        ("a", 10.0, 1.01),
        ("b", 4.0, None),
        ("t", 2.0, None),
        ("z", 100 / mib, None),
    ]


def test_buffers(spark):
    buffers = [{"class_id": c, "objd": o, "status": "xcur"} for c, o in ((1, 7), (1, 8), (19, 7), (4, 9))]
    t = {
        "buffer_header": frame(spark, "buffer_header", buffers),
        "object": frame(
            spark,
            "object",
            [{"data_object_id": i, "object_name": n} for i, n in ((7, "A"), (8, "A"), (9, "B"))],
        ),
    }
    columns = ["object_name", "block_class", "blkcount", "blkcount_total"]
    assert row_set(op.buffer_summary(t), *columns) == [
        ("A", "data block", 2, 3),
        ("A", None, 1, 3),
        ("B", "segment header", 1, 1),
    ]
    assert op.buffer_summary(t, object_names=["B"]).count() == 1


def test_parameters(spark):
    names = ["_optimizer_x_stats", "Xoptimizer_stats", "other"]
    values = [{"indx": i, "value": str(i)} for i in range(3)]
    t = {
        "param_def": frame(spark, "param_def", [{"indx": i, "name": n} for i, n in enumerate(names)]),
        "param_session": frame(spark, "param_session", values),
        "param_instance": frame(spark, "param_instance", values[:2]),
    }
    assert row_set(op.parameter_values(t), "parameter") == [(names[1],), (names[0],)]
    assert rows(op.parameter_values(t, names=["other"])) == []
    escaped = op.parameter_values(t, pattern="/_%optimizer%stats%", escape="/")
    assert rows(escaped, "parameter", "session_value", "instance_value") == [(names[0], "0", "0")]
    assert op.parameter_values(t, pattern="_optimizer%stats").count() == 2


def test_daily_statistics_count_whole_snapshots_inside_the_day(spark):
    snaps = [
        snap(1, DAY - HOUR),
        snap(2, DAY),
        snap(3, DAY + 22 * HOUR),
        snap(4, DAY + 23 * HOUR),  # ends at midnight
        {**snap(5, DAY + 5 * HOUR), "startup_time": DAY + 5 * HOUR},  # began with the start
    ]
    values = [
        {**at(i), "stat_name": n, "value": v}
        for i in range(1, 6)
        for n, v in (("logons current", 10), ("Session Connect Time", 1_250_000), ("other", 1))
    ]
    t = {"snapshot": frame(spark, "snapshot", snaps), "sysstat": frame(spark, "sysstat", values)}
    assert rows(op.daily_logons(t, day=DAY)) == [(DAY, "logons current", 20)]
    assert rows(op.daily_connect_time(t, day=DAY + HOUR)) == [(DAY, "Session Connect Time", 3)]
    # over all days the snapshot that ends at midnight is left out of its day too
    assert row_set(op.daily_logons(t), "date_calc", "number_of_logons") == [(DAY, 20)]


def test_statistics_upkeep(spark):
    start = datetime(2022, 9, 9, 12, 34, 56)
    before = start - timedelta(days=1)
    names = {
        "plain": before,
        "fresh": start,
        "xTEST": before,
        "x_test": before,
        "temp_1": before,
        "tempo": before,
        "TTX$1": before,
        "mlog": before,
        "gtt": before,
        "x_old_locked": before,
    }
    t = {
        "tab_statistic": frame(
            spark,
            "tab_statistic",
            [
                {
                    "table_name": n,
                    "last_analyzed": a,
                    "stattype_locked": "ALL" if n.endswith("locked") else None,
                }
                for n, a in names.items()
            ],
        ),
        "user_tbl": frame(
            spark,
            "user_tbl",
            [{"table_name": n, "temporary": "Y" if n == "gtt" else "N"} for n in names],
        ),
        "mview_log": frame(spark, "mview_log", [{"log_table": "mlog"}, {"log_table": "mlog"}]),
    }
    assert row_set(op.locked_stats(t), "table_name") == [("x_old_locked",)]
    assert ("fresh",) in row_set(op.pending_stats(t, since=start), "table_name")
    assert op.pending_stats(t, since=before - HOUR).count() == 0
    assert row_set(op.stats_exclusions(t, since=start)) == [
        ("TTX$1",),
        ("fresh",),
        ("gtt",),
        ("mlog",),
        ("temp_1",),
        ("x_test",),
    ]
    left_out = row_set(op.gather_exclusions(t, since=start))
    assert left_out == sorted([*row_set(op.stats_exclusions(t, since=start)), ("x_old_locked",)])


def test_semi_joins_do_not_multiply(spark):
    extents = [{"file_id": f, "block_id": b, "extent_id": 1} for f, b in ((1, 1), (1, 2), (2, 1))]
    bad = [{"file_id": 1, "block_id": 2}, {"file_id": 1, "block_id": 2}, {"file_id": 2, "block_id": 2}]
    t = {"extent": frame(spark, "extent", extents), "corruption": frame(spark, "corruption", bad)}
    assert rows(op.corrupt_extents(t)) == [(1, 2, 1)]


def test_long_operations(spark):
    def operation(sid, left, opname="other", sql_id="s1"):
        return {"sid": sid, "serial_no": 1, "sql_id": sql_id, "opname": opname, "time_remaining": left}

    active = [
        {"session_id": 1, "session_serial": 1, "sql_id": "s1", "top_level_sql_id": "g"},
        {"session_id": 1, "session_serial": 1, "sql_id": "s1", "top_level_sql_id": "g"},
        {"session_id": 2, "session_serial": 1, "sql_id": "s1", "top_level_sql_id": "h"},
    ]
    t = {
        "longop": frame(
            spark,
            "longop",
            [operation(1, 5), operation(1, 0), operation(2, 5), operation(9, 0, "Gather", "g")],
        ),
        "active_now": frame(spark, "active_now", active),
    }
    assert op.long_operations(t, opname="Gather").count() == 1
    running = op.long_operations_running(t, opname="Gather")
    assert running.columns == t["longop"].columns
    shown = ("sid", "serial_no", "sql_id", "opname", "time_remaining")
    assert rows(running, *shown) == [(1, 1, "s1", "other", 5)]


def test_sessions_repeat_the_progress_column_under_another_name(spark):
    t = {
        "session": frame(
            spark, "session", [{"osuser": u, "action": "x", "sid": i} for i, u in enumerate("ab")]
        )
    }
    got = op.sessions_for_user(t, os_user="b")
    assert got.columns == ["action", "osuser", "action_1", "sid"]
    assert rows(got) == [("x", "b", "x", 1)]


def test_profile(spark):
    data = [(1, "aa", 1.5, date(2024, 1, 1)), (2, None, -0.0, None), (3, "é" * 70, 0.0, None)]
    tables = {
        "t": spark.createDataFrame(data, "k bigint, s string, d double, at date"),
        "left_out": spark.createDataFrame([(1,)], "k int"),
    }
    named = spark.createDataFrame([("left_out",), ("unknown",)], "table_name string")
    want = [
        ("t", "at", 3, 2, 1, 1, "2024-01-01", "2024-01-01"),
        ("t", "d", 3, 0, 2, 8, "-0.0", "1.5"),
        ("t", "k", 3, 0, 3, 8, "1", "3"),
        ("t", "s", 3, 1, 2, 47, "aa", "é" * 70),
    ]
    for exclude in (["left_out"], named):
        for exact_distinct in (True, False):
            got = op.table_profile(
                tables, as_of=DAY, exclude=exclude, exact_distinct=exact_distinct
            )
            found = row_set(got.drop("last_analyzed"))
            assert [r[:6] + r[7:] for r in found] == [r[:6] + r[7:] for r in want]
    with pytest.raises(ValueError):
        op.table_profile({"left_out": tables["left_out"]}, as_of=DAY, exclude=named)


def test_profile_feeds_the_size_estimate(spark):
    data = spark.range(1000).selectExpr("id as A", "if(id % 2 = 0, null, 'abcdef') as B")
    profile = op.table_profile({"TAB": data}, as_of=DAY)
    t = index_tables(spark)
    t["col_stat"] = profile.withColumn("owner", F.lit("T"))
    # column A takes 8 bytes, column B 3 on average over all rows
    assert rows(op.index_size_estimate(t), "index_name", "avg_row_len")[0] == ("I1", 11)


def test_all_reports_on_a_statement(spark):
    from loadlens.sources import Telemetry

    found = op.sql_profile(
        Telemetry(spark, "/root/testdata/sf0.001"), as_of=datetime(2024, 1, 31), sql_ids=["s1"]
    )
    assert list(found) == [
        "sql_common_info",
        "sql_stats_daily",
        "sql_executions",
        "monitor_executions",
        "plan_stats",
        "plan_stats_ash",
    ]
    assert {r for (r,) in rows(found["sql_stats_daily"], "sqlid")} == {"s1"}
    assert found["plan_stats"].count() > 0


def test_a_text_and_its_own_digest_are_two_values(spark):
    from hashlib import sha256

    long_text = "x" * 80
    df = spark.createDataFrame([(long_text,), (sha256(long_text.encode()).hexdigest(),)], "c string")
    got = op.table_profile({"t": df}, as_of=datetime(2024, 1, 31), exact_distinct=True)
    assert [r["num_distinct"] for r in got.collect()] == [2]
