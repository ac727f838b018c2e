"""Where rows used several times are kept, and that reports sorted by Spark can be cut to a top-n."""

from __future__ import annotations

import os
import subprocess
import sys
from datetime import datetime

from loadlens.functions import look_back
from loadlens.operators import multi_plan_queries
from loadlens.operators.common import settled
from loadlens.sources import Telemetry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

NAMED_FOLDER = """
import os, sys
from pyspark.sql import SparkSession
from loadlens.operators.common import settled
folder = sys.argv[1]
spark = (SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", folder).getOrCreate())
kept = settled(spark.range(5))
parts = [f for _, _, files in os.walk(folder) for f in files if f.startswith("part-")]
assert kept.count() == 5 and parts, os.listdir(folder)
"""


def test_rows_are_kept_in_the_folder_the_session_names(tmp_path):
    subprocess.run(
        [sys.executable, "-c", NAMED_FOLDER, str(tmp_path)], cwd=ROOT, check=True, timeout=120
    )


def test_kept_rows_have_no_lineage(spark):
    plan = settled(spark.range(5).groupBy("id").count())._jdf.queryExecution().executedPlan()
    assert "Exchange" not in plan.toString()


def test_top_n_needs_no_full_sort(spark):
    btime, etime = look_back(datetime(2024, 1, 31))
    tables = Telemetry(spark, "/root/testdata/sf0.001")
    top = multi_plan_queries(tables, btime=btime, etime=etime).limit(3)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan
    assert top.count() == 3


def test_size_of_a_side_counts_text_and_rows(spark):
    from loadlens.operators.common import SMALL_BYTES, is_small

    df = spark.createDataFrame([(1, "abcd"), (2, None)], "k bigint, s string")
    assert is_small(df) and is_small(df.where("k > 9"))
    try:
        for limit, small in ((68, True), (67, False), (-1, False)):
            spark.conf.set(SMALL_BYTES, str(limit))
            assert is_small(df) is small, limit
    finally:
        spark.conf.unset(SMALL_BYTES)
