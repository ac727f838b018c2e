"""Shape of the physical plans when no side is small: what a large cluster would run."""

from __future__ import annotations

import re
from datetime import datetime

import pytest

import __spark_entry__ as entry_point
from loadlens.operators.common import SMALL_BYTES
from loadlens.sources import GIVEN, Telemetry

SF_DIR = "/root/testdata/sf0.001"
LARGE = {
    SMALL_BYTES: "-1",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
}
# One row per task is merged into the table's totals.
ONE_ROW_TOTALS = {"table_profile", "index_size_estimate_profiled"}
# One row per task is merged into the bound that the scan of the job log gets.
ONE_BOUND = {f"{name}{two}" for name in ("job_group_summary", "job_sql_attribution_all") for two in ("", "_databases")}
NAMES = sorted(set(entry_point.report_queries()) - {"validate_tables"})


@pytest.fixture(autouse=True)
def large(spark):
    for key, value in LARGE.items():
        spark.conf.set(key, value)
    yield
    for key in LARGE:
        spark.conf.unset(key)


def initial_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NAMES)
def test_no_pairwise_join_and_nothing_whole_in_one_task(spark, name):
    plan = initial_plan(entry_point.queries()[name](spark, SF_DIR))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    if name in ONE_BOUND:
        plan = re.sub(r"functions=\[min\([^\n]*oldest\)#\d+\]\)\n[^\n]*Exchange SinglePartition", "", plan)
    if name not in ONE_ROW_TOTALS:
        assert "SinglePartition" not in plan


@pytest.mark.parametrize("name", ["job_sql_attribution", "job_sql_attribution_all"])
def test_samples_are_read_once_and_reduced_before_the_join(spark, name):
    plan = initial_plan(entry_point.queries()[name](spark, SF_DIR))
    fact_scans = re.findall(r"FileScan parquet \[event_id[^\]]*user_id[^\]]*value", plan)
    assert len(fact_scans) == 1
    join = plan.index("SortMergeJoin", plan.index("Expand"))
    assert "partial_sum(" in plan[join:]


@pytest.mark.parametrize("few", [True, False])
def test_matches_are_reduced_before_the_grouping_sets(spark, few):
    if few:
        for key in LARGE:
            spark.conf.unset(key)
    plan = initial_plan(entry_point.queries()["job_sql_attribution"](spark, SF_DIR))
    assert ("BroadcastHashJoin" in plan) == few
    below = plan[plan.index("Expand") :]
    assert "partial_sum(" in below[: below.index("Join")]


def test_cursors_meet_their_steps_once(spark):
    plan = initial_plan(entry_point.queries()["plan_tree_with_actuals"](spark, SF_DIR))
    # Cursors with plan lines, and both with the actuals; idle steps come from an anti join of keys.
    assert plan.count("Inner") == 2 and plan.count("LeftAnti") == 1 and "LeftOuter" not in plan


def test_headers_are_printed_behind_the_joins(spark):
    for name in ("plan_tree", "plan_monitor_report"):
        plan = initial_plan(entry_point.queries()[name](spark, SF_DIR))
        # Plan rows and what their headers are made of meet once, and are numbered in the same place.
        assert plan.count("Exchange hashpartitioning") == 2
        below = plan[plan.index("SortMergeJoin") :]
        assert ", ela = " not in below and ", lio = " not in below


def given_plans(spark, folder):
    """Orders 0 to 39 and their lines: ties, some lines twice, one long plan, lines without an order, null keys."""
    day = datetime(2024, 1, 1)
    orders = [(k, k, "O", 10.0 * k, day, "LOW") for k in range(40)]
    # By quantity alone the first two lines of an order differ; at most 10 sends a later step elsewhere.
    lines = [
        (k, 7, 2, 1, float(q), 5.0, 0.0, 0.0, "A", "F", day)
        for k in [*range(45), None]
        for q in (3 + k if k else 30, 4, *[11] * (k % 3 if k else 0), *range(200 if k == 7 else 0))
    ]
    for name, rows in (("orders", orders), ("lineitem", lines)):
        spark.createDataFrame(rows, GIVEN[name]).repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return orders, lines


def test_steps_and_actuals_meet_where_their_plan_lies(spark, tmp_path):
    orders, lines = given_plans(spark, tmp_path)
    df = entry_point.queries()["plan_tree_with_actuals"](spark, str(tmp_path))
    got = [(r.sql_id, r.plan_hash_value, r.sql_exec_id, r.id, r.starts) for r in df.collect()]
    expected = []
    for key in sorted((o[0] for o in orders), key=str):
        for step, cost in enumerate(sorted(int(line[4]) for line in lines if line[0] == key)):
            seen = cost > 10 or step == 0
            actual = (16777216 + (1000 + key) % 3, cost) if seen else (None, None)
            expected += [(f"s{key}", 1000 + key, actual[0], i, actual[1]) for i in ([None, 0] if step == 0 else [step])]
    assert got == expected
    # Cursors and lines are moved once each, before the order of the report; actuals and idle steps reuse the lines.
    ran = df._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]
    assert len(re.findall(r"(?<!Reused)Exchange hashpartitioning", re.sub(r"ReusedExchange[^\n]*", "", ran))) == 2
    assert ran.count("ReusedExchange") == 3


def test_meeting_by_plan_or_by_step_gives_the_same_rows(spark, tmp_path):
    given_plans(spark, tmp_path)
    report = entry_point.plans.plan_tree_with_actuals
    found = {}
    try:
        for whole in ("true", "false"):
            spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", whole)
            df = report(Telemetry(spark, str(tmp_path)))
            # By step, sides that lie by nothing smaller meet in exchanges of their own, which Spark can split.
            by_step = re.findall(r"Exchange hashpartitioning\([^\n]*plan_hash_value#\d+L, [^\n]*id#", initial_plan(df))
            assert bool(by_step) == (whole == "true")
            found[whole] = df.collect()
    finally:
        spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")
    assert found["true"] == found["false"] and len(found["true"]) > 200


def test_other_reports_keep_joins_by_whole_keys(spark):
    entry_point.queries()["plan_tree_with_actuals"](spark, SF_DIR)
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "false"
    entry_point.queries()["plan_lines"](spark, SF_DIR)
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_steps_are_made_behind_the_window(spark):
    plan = initial_plan(entry_point.queries()["plan_tree"](spark, SF_DIR))
    assert "OP_" in plan and "OP_" not in plan[plan.index("Window [row_number") :]


def test_one_plan_row_per_statement_reads_the_fact_once(spark):
    plan = initial_plan(entry_point.queries()["multi_plan_queries"](spark, SF_DIR))
    assert len(re.findall(r"FileScan parquet \[event_id", plan)) == 1


def test_columns_are_pruned_and_filters_pushed(spark):
    plan = initial_plan(entry_point.queries()["sessions_for_user"](spark, SF_DIR))
    assert "EqualTo(c_mktsegment,BUILDING)" in plan
    assert "c_acctbal" not in plan
    plan = initial_plan(entry_point.queries()["sql_text"](spark, SF_DIR))
    assert "p_retailprice" not in plan


def test_latest_day_is_kept_before_the_exchange(spark):
    from loadlens.operators import queries_by_text

    plan = initial_plan(queries_by_text(Telemetry(spark, SF_DIR), patterns=["SELECT"]))
    assert re.search(r"WindowGroupLimit[^\n]*Partial", plan)
