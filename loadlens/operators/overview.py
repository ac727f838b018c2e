"""All reports on given statements at once."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import DataFrame

from loadlens.functions import look_back
from loadlens.operators.common import Tables
from loadlens.operators.sessions import monitor_executions, plan_stats_ash, sql_executions
from loadlens.operators.statements import plan_stats, sql_common_info, sql_stats_daily


def sql_profile(
    tables: Tables, *, as_of: datetime, sql_ids: Iterable[str] | None = None
) -> dict[str, DataFrame]:
    """The reports on the statements over the 30 days before ``as_of``, by report name.

    Building them runs the small size jobs that the reports with a window need.
    """
    ids = None if sql_ids is None else list(sql_ids)
    btime, etime = look_back(as_of)
    window = {"btime": btime, "etime": etime, "sql_ids": ids}
    _, tomorrow = look_back(as_of, ahead=1)
    return {
        "sql_common_info": sql_common_info(tables, sql_ids=ids),
        "sql_stats_daily": sql_stats_daily(tables, **{**window, "etime": tomorrow}),
        "sql_executions": sql_executions(tables, **window),
        "monitor_executions": monitor_executions(tables, sql_ids=ids),
        "plan_stats": plan_stats(tables, **window),
        "plan_stats_ash": plan_stats_ash(tables, **window),
    }
