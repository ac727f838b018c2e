"""Every registered query against its check SQL, on the broadcast path and on the path beyond it."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_point
from checks import check_sql
from compare import connect, duck_rows, spark_rows
from loadlens.operators.common import SMALL_BYTES

SF_DIR = "/root/testdata/sf0.01"
QUERIES = entry_point.report_queries()
CHECKS = check_sql()

# Reports that choose between a broadcast and another way by the size of a side.
SIZE_CHECKED = [
    "sql_stats_daily",
    "sql_executions",
    "plan_stats",
    "plan_stats_ash",
    "multi_plan_queries",
    "queries_by_text",
    "job_sql_attribution",
    "job_sql_attribution_all",
    "daily_logons",
    "daily_connect_time",
    "sql_common_info",
    "corrupt_extents",
    "long_operations_running",
]


@pytest.fixture(scope="module")
def duck():
    con = connect(SF_DIR)
    yield con
    con.close()


def test_all_have_check_sql():
    assert set(CHECKS) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_same_rows(spark, duck, name):
    got, want = spark_rows(QUERIES[name](spark, SF_DIR)), duck_rows(duck, CHECKS[name])
    assert got[0] == want[0]
    assert len(want[1]) > 0
    assert got[1] == want[1]


@pytest.mark.parametrize("name", SIZE_CHECKED)
def test_same_rows_without_broadcast(spark, duck, name):
    settings = {
        SMALL_BYTES: "-1",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        got = spark_rows(QUERIES[name](spark, SF_DIR))
    finally:
        for key in settings:
            spark.conf.unset(key)
    assert got == duck_rows(duck, CHECKS[name])


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.columns == [
        "sql_id",
        "loaded_plans",
        "last_load_time",
        "min_elapsed",
        "max_elapsed",
        "percent",
    ]
    assert df.count() > 0
