"""Telemetry tables written to parquet and read back."""

from __future__ import annotations

from datetime import datetime

import pytest

from compare import spark_rows
from loadlens.functions import look_back
from loadlens.operators import (
    daily_logons,
    job_sql_attribution,
    plan_stats,
    queries_by_text,
    sql_executions,
)
from loadlens.sources import FACTS, SCHEMAS, Telemetry, read_telemetry, write_telemetry

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("telemetry"))
    views = Telemetry(spark, SF_DIR)
    write_telemetry({name: views[name] for name in views}, root)
    return read_telemetry(spark, root)


def test_views_have_the_declared_columns_and_types(spark):
    views = Telemetry(spark, SF_DIR)
    assert set(views) == set(SCHEMAS)
    for name in views:
        declared = dict(spark.createDataFrame([], SCHEMAS[name]).dtypes)
        assert dict(views[name].dtypes).keys() == declared.keys(), name
        for column, kind in views[name].dtypes:
            if declared[column] != kind:  # ids of the views may be narrower whole numbers
                assert {declared[column], kind} == {"int", "bigint"}, (name, column, kind)


def test_stored_tables_hold_the_rows_of_the_views(spark, stored):
    views = Telemetry(spark, SF_DIR)
    for name in ("snapshot", "sqlstat", "ash", "job_run", "plan_monitor"):
        back = stored[name].drop("snap_day") if name in FACTS else stored[name]
        assert spark_rows(back.select(*views[name].columns)) == spark_rows(views[name]), name


def test_reports_on_stored_tables_equal_reports_on_views(spark, stored):
    views = Telemetry(spark, SF_DIR)
    window = dict(zip(("btime", "etime"), (datetime(2024, 1, 5, 7), datetime(2024, 1, 9, 13))))
    for report in (
        lambda t: plan_stats(t, **window),
        lambda t: sql_executions(t, **window),
        lambda t: daily_logons(t, day=datetime(2024, 1, 6)),
        lambda t: queries_by_text(t, patterns=["RED_WIDGET"]),
        lambda t: job_sql_attribution(t, job_like="TASK$_1%"),
    ):
        assert spark_rows(report(stored)) == spark_rows(report(views))


def test_window_skips_stored_days_and_snapshot_ranges(spark, stored):
    btime, etime = look_back(datetime(2024, 1, 9), days=2)
    scan = fact_scan(sql_executions(stored, btime=btime, etime=etime), "tm_delta_db_time")
    assert "PartitionFilters: [isnotnull(snap_day" in scan
    assert "GreaterThanOrEqual(snap_id" in scan and "LessThanOrEqual(snap_id" in scan


def fact_scan(df, column):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return next(line for line in plan.splitlines() if column in line and "FileScan" in line)


def test_job_attribution_reads_the_days_of_its_jobs(spark, stored):
    early = {**stored, "job_run": stored["job_run"].where("req_start_date < '2024-01-03'")}
    scan = fact_scan(job_sql_attribution(early, job_like="TASK$_%"), "tm_delta_db_time")
    assert "snap_day#" in scan and "<= 2024-01-02" in scan
    assert "LessThanOrEqual(snap_id" in scan


def test_samples_of_unknown_snapshots_are_still_attributed(spark, tmp_path):
    from datetime import timedelta

    from frames import DAY, at, frame, rows, snap

    hour = timedelta(hours=1)
    tables = {
        "snapshot": frame(spark, "snapshot", [snap(1, DAY), snap(3, DAY + 2 * hour)]),
        "ash": frame(
            spark,
            "ash",
            [{**at(i), "session_id": 1, "session_serial": 2, "sql_id": "a"} for i in (1, 2, 3, 4)],
        ),
        "job_run": frame(
            spark,
            "job_run",
            [
                {
                    "job_name": "TASK$_1_1",
                    "session_id": "1,2",
                    "req_start_date": DAY + hour / 2,
                    "run_duration": 2 * hour,
                }
            ],
        ),
    }
    write_telemetry(tables, str(tmp_path))
    stored = read_telemetry(spark, str(tmp_path), tables)
    got = job_sql_attribution(stored, job_like="TASK$_%")
    assert rows(got, "job_prefix", "rowcount") == [("TASK$_1", 3), (None, 3)]


def test_existing_tables_are_not_overwritten(spark, tmp_path):
    from pyspark.errors import AnalysisException

    views = Telemetry(spark, SF_DIR)
    write_telemetry({"object": views["object"]}, str(tmp_path))
    with pytest.raises(AnalysisException):
        write_telemetry({"object": views["object"]}, str(tmp_path))


def test_facts_without_a_snapshot_are_stored_too(spark, tmp_path):
    from frames import at, frame

    fact = frame(spark, "sysstat", [{**at(7), "stat_name": "x", "value": 1}])
    write_telemetry({"sysstat": fact, "snapshot": frame(spark, "snapshot")}, str(tmp_path))
    (row,) = read_telemetry(spark, str(tmp_path), ["sysstat"])["sysstat"].collect()
    assert (row["snap_id"], row["value"], row["snap_day"]) == (7, 1, None)
