"""The reports. Each is a function from telemetry tables and keyword parameters to a DataFrame."""

from loadlens.operators.indexes import index_size_estimate, index_usage
from loadlens.operators.jobs import (
    add_snaps,
    job_group_summary,
    job_sql_attribution,
    job_sql_attribution_all,
)
from loadlens.operators.overview import sql_profile
from loadlens.operators.profiling import (
    Index,
    index_profile,
    merged_profile,
    profile_parts,
    profiled_catalog,
    table_profile,
)
from loadlens.operators.sessions import (
    long_operations,
    long_operations_running,
    monitor_executions,
    monitor_rows,
    plan_stats_ash,
    sessions_for_user,
    sql_executions,
)
from loadlens.operators.settings import (
    daily_connect_time,
    daily_logons,
    daily_stat_sum,
    parameter_values,
)
from loadlens.operators.statements import (
    multi_plan_queries,
    plan_stats,
    queries_by_text,
    sql_common_info,
    sql_stats_daily,
    sql_text,
)
from loadlens.operators.storage import (
    buffer_summary,
    corrupt_extents,
    tablespace_free,
    tablespace_usage,
)
from loadlens.operators.upkeep import (
    gather_exclusions,
    locked_stats,
    pending_stats,
    stats_exclusions,
)
from loadlens.operators.validation import Dataset, index_discrepancies, validate_tables

__all__ = [
    "Dataset",
    "Index",
    "add_snaps",
    "buffer_summary",
    "corrupt_extents",
    "daily_connect_time",
    "daily_logons",
    "daily_stat_sum",
    "gather_exclusions",
    "index_discrepancies",
    "index_profile",
    "index_size_estimate",
    "index_usage",
    "job_group_summary",
    "job_sql_attribution",
    "job_sql_attribution_all",
    "locked_stats",
    "long_operations",
    "long_operations_running",
    "merged_profile",
    "monitor_executions",
    "monitor_rows",
    "multi_plan_queries",
    "parameter_values",
    "pending_stats",
    "plan_stats",
    "plan_stats_ash",
    "profile_parts",
    "profiled_catalog",
    "queries_by_text",
    "sessions_for_user",
    "sql_common_info",
    "sql_executions",
    "sql_profile",
    "sql_stats_daily",
    "sql_text",
    "stats_exclusions",
    "table_profile",
    "tablespace_free",
    "tablespace_usage",
    "validate_tables",
]
