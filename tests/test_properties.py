"""Relations between reports, and reports on skewed data against plain Python."""

from __future__ import annotations

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from frames import DAY, at, frame, row_set, rows, snap
from loadlens import operators as op
from loadlens.functions import look_back
from loadlens.operators.common import SMALL_BYTES
from loadlens.sources import Telemetry

SF_DIR = "/root/testdata/sf0.001"
BTIME, ETIME = look_back(datetime(2024, 1, 31))
HOUR = timedelta(hours=1)
LARGE = {
    SMALL_BYTES: "-1",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
}


@pytest.fixture(params=["few", "many"])
def either_way(request, spark):
    settings = LARGE if request.param == "many" else {}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key in settings:
        spark.conf.unset(key)


def test_daily_executions_add_up_to_the_window(spark):
    t = Telemetry(spark, SF_DIR)
    daily = op.sql_stats_daily(t, btime=BTIME, etime=ETIME)
    summed = daily.groupBy("sqlid", "phv").agg(F.sum("e").alias("e"))
    assert row_set(summed) == row_set(
        op.plan_stats(t, btime=BTIME, etime=ETIME), "sql_id", "plan_hash_value", "e"
    )


def test_attribution_total_is_the_sum_of_its_groups(spark):
    got = op.job_sql_attribution(Telemetry(spark, SF_DIR), job_like="TASK$_%").collect()
    groups, (total,) = [r for r in got if r[0] is not None], [r for r in got if r[0] is None]
    assert total["rowcount"] == sum(r["rowcount"] for r in groups)
    assert abs(total["db_time"] - sum(r["db_time"] or 0 for r in groups)) <= len(groups)


def test_every_tablespace_with_files_is_listed(spark):
    t = Telemetry(spark, SF_DIR)
    files = t["data_file"].select("tablespace_name").union(t["temp_file"].select("tablespace_name"))
    assert row_set(op.tablespace_free(t), "tablespace_name") == row_set(files.distinct())


def test_buffer_totals_cover_all_buffers_of_known_objects(spark):
    t = Telemetry(spark, SF_DIR)
    got = op.buffer_summary(t)
    known = t["buffer_header"].join(
        t["object"].withColumnRenamed("data_object_id", "objd"), "objd"
    )
    assert rows(got.agg(F.sum("blkcount"))) == [(known.count(),)]


def test_hot_statement_execution_report(spark, either_way):
    """One statement, session and execution hold most samples."""
    rng = random.Random(5)
    snaps = [snap(i, DAY + i * HOUR) for i in range(1, 13)]
    samples = []
    for i in range(3000):
        hot = rng.random() < 0.6
        samples.append(
            {
                **at(7 if hot else rng.randint(1, 14)),
                "sample_time": DAY + timedelta(seconds=i),
                "sql_id": "hot" if hot else f"s{rng.randint(1, 40)}",
                "sql_plan_hash_value": 1,
                "sql_exec_id": 1 if hot else rng.randint(1, 3),
                "session_id": 1 if hot else rng.randint(1, 9),
                "session_serial": 1,
                "tm_delta_db_time": rng.randint(0, 10**6),
                "in_parse": rng.choice(["Y", "N", None]),
            }
        )
    want = defaultdict(lambda: [0, 0, 0])
    for s in samples:
        if s["snap_id"] <= 12:
            key = (s["sql_id"], s["sql_exec_id"], f"{s['session_id']},1")
            want[key][0] += 1
            want[key][1] += s["tm_delta_db_time"]
            want[key][2] += s["in_parse"] == "Y"
    t = {"snapshot": frame(spark, "snapshot", snaps), "ash": frame(spark, "ash", samples)}
    got = op.sql_executions(t, btime=None, etime=None)
    columns = ["sql_id", "sql_exec_id", "sid_serial", "wait_count", "db_time", "parse"]
    assert row_set(got, *columns) == sorted(
        ((*k, n, int(db / 10_000 + 0.5) / 100, p) for k, (n, db, p) in want.items()), key=repr
    )


def test_hot_session_attribution(spark, either_way):
    """One session runs most jobs and holds most samples; jobs overlap and repeat."""
    rng = random.Random(11)
    snaps = [snap(i, DAY + i * HOUR) for i in range(1, 25)]
    jobs, samples = [], []
    for _ in range(250):
        session = 1 if rng.random() < 0.5 else rng.randint(2, 12)
        start = DAY + HOUR + timedelta(minutes=rng.randint(0, 26 * 60))
        jobs.append(
            {
                "job_name": f"TASK$_{rng.randint(1, 4)}_{rng.randint(1, 30)}",
                "session_id": f"{session},{session}",
                "req_start_date": start,
                "run_duration": timedelta(minutes=rng.choice([0, 5, 50, 200, 900])),
            }
        )
    for _ in range(1500):
        session = 1 if rng.random() < 0.5 else rng.randint(2, 12)
        samples.append(
            {
                **at(rng.randint(1, 24)),
                "session_id": session,
                "session_serial": session if rng.random() < 0.8 else 99,
                "sql_id": rng.choice(["a", "b", "c", None]),
                "sql_exec_id": rng.choice([1, 2, None]),
                "sql_exec_start": rng.choice([DAY, None]),
                "tm_delta_db_time": rng.choice([None, 10**6, 3 * 10**6]),
            }
        )

    def snap_of(time):
        found = [s["snap_id"] for s in snaps if s["begin_interval_time"] <= time <= s["end_interval_time"]]
        return min(found) if found else None

    want = defaultdict(lambda: {"n": 0, "db": [], "runs": set(), "low": [], "high": []})
    for j in jobs:
        prefix = j["job_name"].rsplit("_", 1)[0]
        low = snap_of(j["req_start_date"])
        high = snap_of(j["req_start_date"] + j["run_duration"])
        sid = int(j["session_id"].split(",")[0])
        matched = [
            s
            for s in samples
            if None not in (low, high)
            and low <= s["snap_id"] <= high
            and (s["session_id"], s["session_serial"]) == (sid, sid)
        ]
        for s in matched or [None]:
            for key in ((prefix, s and s["sql_id"]), (None, None)):
                group = want[key]
                group["n"] += 1
                group["low"] += [low] if low else []
                group["high"] += [high] if high else []
                if s and s["tm_delta_db_time"] is not None:
                    group["db"].append(s["tm_delta_db_time"])
                if s and (s["sql_exec_id"] or s["sql_exec_start"]):
                    group["runs"].add((s["sql_exec_id"], s["sql_exec_start"]))
    expected = []
    for (prefix, sql_id), g in want.items():
        low, high = (str(f(g[k])) if g[k] else "" for f, k in ((min, "low"), (max, "high")))
        db = sum(g["db"]) // 10**6 if g["db"] else None
        expected.append((prefix, sql_id, f"{low}-{high}", len(g["runs"]), g["n"], db))
    t = {
        "job_run": frame(spark, "job_run", jobs),
        "snapshot": frame(spark, "snapshot", snaps),
        "ash": frame(spark, "ash", samples),
    }
    got = op.job_sql_attribution(t, job_like="TASK$_%").drop("cpu_time", "dbid")
    assert row_set(got) == sorted(expected, key=repr)


def test_hot_step_keeps_every_execution(spark, either_way):
    """One plan step monitored thousands of times, next to steps never monitored."""
    from loadlens import plans

    steps = [{"sql_id": s, "plan_hash_value": 1, "id": i} for s in ("hot", "cold") for i in range(3)]
    cursors = [{"sql_id": s, "plan_hash_value": 1, "child_number": 0} for s in ("hot", "cold")]
    monitored = [
        {"sql_id": "hot", "sql_plan_hash_value": 1, "plan_line_id": 2, "sql_exec_id": i}
        for i in range(4000)
    ]
    t = {
        "plan_line": frame(spark, "plan_line", steps),
        "sql_area": frame(spark, "sql_area", cursors),
        "plan_monitor": frame(spark, "plan_monitor", monitored),
    }
    got = plans.plan_tree_with_actuals(t).groupBy("sql_id", "id").count()
    assert row_set(got) == [
        ("cold", 0, 1),
        ("cold", 1, 1),
        ("cold", 2, 1),
        ("cold", None, 1),
        ("hot", 0, 1),
        ("hot", 1, 1),
        ("hot", 2, 4000),
        ("hot", None, 1),
    ]


def test_hot_snapshot_join_is_split(spark):
    """Beyond the broadcast limit a snapshot that holds most rows is split over tasks."""
    settings = {
        **LARGE,
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        snaps = frame(spark, "snapshot", [snap(i, DAY + i * HOUR) for i in range(1, 40)])
        fact = spark.range(0, 400_000, 1, 16).selectExpr(
            "1 as dbid",
            "1 as instance_number",
            "cast(if(id % 3 = 0, 7, id % 39 + 1) as bigint) as snap_id",
            "concat('s', xxhash64(id)) as sql_id",
            "id as plan_hash_value",
            "1L as executions_delta",
            "id as elapsed_time_delta",
        )
        got = op.plan_stats({"snapshot": snaps, "sqlstat": fact}, btime=None, etime=None)
        assert got.agg(F.sum("e")).collect() == [(400_000,)]
        df = op.plan_stats({"snapshot": snaps, "sqlstat": fact}, btime=None, etime=None)
        df.collect()
        assert "isSkewJoin=true" in df._jdf.queryExecution().executedPlan().toString() or (
            "SortMergeJoin(skew=true)" in df._jdf.queryExecution().executedPlan().toString()
        )
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
