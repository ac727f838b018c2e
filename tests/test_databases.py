"""Logs of several databases, retention from the control table, spans as aligned blocks, open tables, stored reports."""

from __future__ import annotations

from collections import ChainMap
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from frames import DAY, at, frame, row_set, rows, snap
from loadlens import operators as op
from loadlens.operators.jobs import aligned_blocks
from loadlens.sources import SCHEMAS, Telemetry, read_report, read_telemetry, write_report, write_telemetry
from loadlens.sources.fixtures import two_databases

HOUR = timedelta(hours=1)


def run(name, session, start, hours, dbid):
    return {"dbid": dbid, "job_name": name, "session_id": session, "req_start_date": start,
            "run_duration": hours * HOUR, "cpu_used": HOUR}


def sample(snap_id, sql_id, db, dbid):
    return {**at(snap_id, dbid=dbid), "session_id": 1, "session_serial": 2, "sql_id": sql_id, "tm_delta_db_time": db * 10**6}


@pytest.fixture
def two(spark, tmp_path):
    """Two databases with the same jobs, sessions and snapshot ids, written and read back."""
    tables = {
        "snapshot": frame(spark, "snapshot", [snap(k, DAY + k * HOUR, dbid=d) for k in range(6) for d in (1, 2)]),
        "job_run": frame(
            spark, "job_run",
            [run("TASK$_1_1", "1,2", DAY + HOUR / 2, 2, 1), run("TASK$_1_1", "1,2", DAY + 3.5 * HOUR, 1, 2),
             run("TASK$_1_2", "9,9", DAY - timedelta(days=8), 1, 1), run("TASK$_1_2", "9,9", DAY - timedelta(days=8), 1, 2),
             run("TASK$_1_3", "9,9", DAY, 1, 3)],
        ),
        "ash": frame(spark, "ash", [sample(k, f"s{k}", 10 * d + k, d) for k in range(6) for d in (1, 2)]),
        "parallel_task": frame(spark, "parallel_task"),
        "wr_control": frame(
            spark, "wr_control",
            [{"dbid": 1, "retention": timedelta(days=30)}, {"dbid": 2, "retention": timedelta(days=3)}],
        ),
    }
    write_telemetry(tables, str(tmp_path))
    return read_telemetry(spark, str(tmp_path), tables)


def test_databases_with_the_same_ids_are_not_mixed(two):
    found = op.job_sql_attribution(two, job_like="TASK$_1_1")
    assert row_set(found, "dbid", "sql_id", "range_snap", "db_time") == sorted(
        [(1, "s0", "0-2", 10), (1, "s1", "0-2", 11), (1, "s2", "0-2", 12), (2, "s3", "3-4", 23), (2, "s4", "3-4", 24),
         (None, None, "0-4", 80)], key=repr,
    )


def test_each_database_keeps_its_own_retention(two):
    as_of = DAY + timedelta(days=1)
    found = op.job_group_summary(two, as_of=as_of)
    assert row_set(found, "dbid", "job_count") == [(1, 2), (2, 1)]
    assert row_set(op.job_group_summary(two, as_of=as_of, retention=timedelta(days=30)), "dbid", "job_count") == [
        (1, 2), (2, 2), (3, 1)]
    found = op.job_sql_attribution_all(two, as_of=as_of)
    assert {(r["dbid"], r["job_count"]) for r in found.collect()} == {(1, 2), (2, 1)}


def test_log_without_databases_uses_the_earliest_bound(two):
    log = ChainMap({"job_run": two["job_run"].drop("dbid")}, two)
    assert rows(op.job_group_summary(log, as_of=DAY + timedelta(days=1)), "job_count") == [(3,)]
    none = ChainMap({"wr_control": two["wr_control"].limit(0)}, log)
    assert rows(op.job_group_summary(none, as_of=DAY)) == []


def test_bound_reaches_the_scan_and_databases_are_folders(two):
    scan = op.job_group_summary(two, as_of=DAY).where("dbid = 2")._jdf.queryExecution().executedPlan().toString()
    line = next(x for x in scan.splitlines() if "FileScan" in x and "job_name" in x)
    assert "GreaterThanOrEqual(req_start_date,ScalarSubquery" in line and "PartitionFilters: [isnotnull(dbid" in line, line


def test_view_of_two_databases_holds_both(spark):
    t = two_databases(Telemetry(spark, "/root/testdata/sf0.001"))
    for name in ("snapshot", "ash", "job_run"):
        assert {r[0] for r in t[name].select("dbid").distinct().collect()} == {1, 2}


@pytest.mark.parametrize("collected", [[], [0], [0, 1]])
def test_unknown_use_counts_only_where_use_is_collected(spark, collected):
    t = {name: frame(spark, name) for name in ("tab_modification", "constraint_def", "object_usage")}
    t |= {
        "idx": frame(spark, "idx", [{"owner": "O", "index_name": i, "table_owner": "O", "table_name": "T"} for i in "AB"]),
        "tbl": frame(spark, "tbl", [{"owner": "O", "table_name": "T"}]),
        "index_segment": frame(spark, "index_segment", [{"owner": "O", "segment_name": i, "bytes": 1} for i in "AB"]),
        "index_usage": frame(spark, "index_usage", [{"owner": "O", "name": "A", "last_used": DAY - timedelta(days=9)}]),
        "index_usage_info": frame(spark, "index_usage_info", [{"index_stats_enabled": k} for k in collected]),
    }
    found = op.index_usage(t, unused_for=timedelta(days=2), as_of=DAY)
    assert row_set(found, "index_name") == ([("A",), ("B",)] if 1 in collected else [("A",)])


def test_blocks_cover_spans_once(spark):
    spans = [(a, b) for a in range(1, 40) for b in range(a - 2, 41)] + [(2**40 - 3, 2**40 + 5), (0, 0), (0, 63), (7, 7)]
    table = spark.createDataFrame(spans, "a bigint, b bigint")
    for r in table.select("a", "b", aligned_blocks("a", "b").alias("x")).collect():
        held = [n for level, block in r["x"] for n in range(block << level, (block + 1) << level)]
        assert sorted(held) == list(range(r["a"], r["b"] + 1)), r


def test_long_span_gives_few_blocks(spark):
    table = spark.createDataFrame([(12_345, 12_345 + 10**9)], "a bigint, b bigint")
    (found,) = table.select(aligned_blocks("a", "b").alias("x")).first()
    assert len(found) <= 60 and sum(1 << level for level, _ in found) == 10**9 + 1


@pytest.mark.parametrize("limit", ["134217728", "-1"])
def test_job_over_very_many_snapshots(spark, limit):
    """A job from the first to the last of 1e9 snapshots meets its samples; nothing is listed by id."""
    first, last = 100, 100 + 10**9
    t = {
        "snapshot": frame(spark, "snapshot", [snap(first, DAY), snap(last, DAY + 5 * HOUR)]),
        "job_run": frame(spark, "job_run", [run("TASK$_1_1", "1,2", DAY + HOUR / 2, 5, 1), run("TASK$_2_1", "1,2", DAY, 0.5, 1)]),
        "ash": frame(spark, "ash", [sample(k, "q", 1, 1) for k in (99, 100, 101, 5000, 10**8, last, last + 1)]),
    }
    spark.conf.set("spark.loadlens.broadcastBytes", limit)
    try:
        got = op.job_sql_attribution(t, job_like="TASK$_%")
        assert row_set(got, "job_prefix", "rowcount") == [("TASK$_1", 5), ("TASK$_2", 1), (None, 6)]
        assert "sequence(start_snap" not in got._jdf.queryExecution().analyzed().toString()
    finally:
        spark.conf.unset("spark.loadlens.broadcastBytes")


def test_open_tables_return_columns_beyond_the_schema(spark, tmp_path):
    root = str(tmp_path)
    views = Telemetry(spark, "/root/testdata/sf0.001")
    names = ("sqltext", "extent", "corruption", "session", "tab_statistic", "longop", "active_now")
    write_telemetry({n: views[n].limit(50) for n in names}, root)
    for n in names[:-1]:
        views[n].limit(3).withColumn("con_id", F.lit(7)).write.mode("append").parquet(f"{root}/{n}")
    t = read_telemetry(spark, root, names)
    reports = {
        "sqltext": op.sql_text(t, all_columns=True),
        "extent": op.corrupt_extents(t),
        "session": op.sessions_for_user(t, os_user="BUILDING"),
        "tab_statistic": op.pending_stats(t, since=datetime(2030, 1, 1)),
        "longop": op.long_operations(t, opname="click"),
    }
    for n, report in reports.items():
        assert report.columns[-1] == "con_id", n
        core = dict(spark.createDataFrame([], SCHEMAS[n]).dtypes)
        assert core.items() <= dict(t[n].dtypes).items()
    assert {r["con_id"] for r in t["sqltext"].collect()} == {None, 7}
    assert "con_id" not in t["corruption"].columns
    assert "con_id" not in read_telemetry(spark, root, ["session"], open_tables=())["session"].columns


def test_open_table_without_files_has_its_declared_columns(spark, tmp_path):
    (tmp_path / "session").mkdir()
    t = read_telemetry(spark, str(tmp_path), ["session"])
    assert t["session"].columns == ["osuser", "action", "sid"] and t["session"].count() == 0


def test_rerun_of_a_report_replaces_its_day_only(spark, tmp_path):
    root = str(tmp_path)
    schema = "k bigint, v string"
    made = lambda *data: spark.createDataFrame(list(data), schema)
    for _ in range(2):
        write_report(made((1, "a"), (2, "b")), root, "r", day=date(2024, 1, 1))
    write_report(made((3, "c")), root, "r", day=date(2024, 1, 2))
    write_report(made((1, "new")), root, "r", day=datetime(2024, 1, 1, 5))
    back = read_report(spark, root, "r", schema)
    assert row_set(back) == [(1, "new", date(2024, 1, 1)), (3, "c", date(2024, 1, 2))]
    write_report(made(), root, "r", day=date(2024, 1, 1))
    assert row_set(read_report(spark, root, "r", schema)) == [(3, "c", date(2024, 1, 2))]
    scan = back.where("report_day = '2024-01-02'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(report_day" in scan
    with pytest.raises(ValueError):
        write_report(made(), root, "r")


def test_report_over_days_replaces_the_days_it_has(spark, tmp_path):
    root, schema = str(tmp_path), "tl timestamp, e bigint"
    days = [datetime(2024, 1, d) for d in (1, 2, 3)]
    write_report(spark.createDataFrame([(d, 1) for d in days], schema), root, "daily", by="tl")
    write_report(spark.createDataFrame([(days[1], 5), (days[1], 6)], schema), root, "daily", by="tl")
    found = read_report(spark, root, "daily", schema)
    assert row_set(found, "e", "report_day") == [(1, date(2024, 1, 1)), (1, date(2024, 1, 3)), (5, date(2024, 1, 2)), (6, date(2024, 1, 2))]
