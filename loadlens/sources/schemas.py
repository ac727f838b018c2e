"""Schemas of the telemetry tables. Reads name them, so no file is opened to infer a schema."""

from __future__ import annotations

_SNAP = "dbid int, instance_number int, snap_id bigint"

# Steps of plans, those in memory and those kept.
_PLAN_LINE = (
    "sql_id string, plan_hash_value bigint, id int, depth int, operation string, "
    "options string, object_owner string, object_name string, object_type string, "
    "optimizer string, cost bigint, cardinality bigint, bytes bigint, cpu_cost bigint, "
    "io_cost bigint, access_predicates string, filter_predicates string, projection string"
)

SCHEMAS: dict[str, str] = {
    # interval snapshots and what is measured per interval
    "snapshot": f"{_SNAP}, begin_interval_time timestamp, end_interval_time timestamp, "
    "startup_time timestamp",
    "sqlstat": f"{_SNAP}, sql_id string, plan_hash_value bigint, module string, "
    "executions_delta bigint, elapsed_time_delta bigint, cpu_time_delta bigint, "
    "iowait_delta bigint, ccwait_delta bigint, apwait_delta bigint, plsexec_time_delta bigint, "
    "javexec_time_delta bigint, disk_reads_delta bigint, buffer_gets_delta bigint, "
    "rows_processed_delta bigint, parse_calls_delta bigint, px_servers_execs_delta bigint",
    "ash": f"{_SNAP}, sample_time timestamp, session_id bigint, session_serial bigint, "
    "sql_id string, sql_plan_hash_value bigint, sql_exec_id bigint, sql_exec_start timestamp, "
    "tm_delta_db_time bigint, tm_delta_cpu_time bigint, delta_read_io_bytes bigint, "
    "delta_write_io_bytes bigint, in_parse string, in_hard_parse string, "
    "in_sql_execution string, in_plsql_execution string, in_java_execution string, "
    "in_cursor_close string",
    "sysstat": f"{_SNAP}, stat_name string, value bigint",
    # statements and their plans
    "sqltext": "sql_id string, command_type int, sql_text string",
    "command_name": "command_type int, command_name string",
    "sql_area": "sql_id string, plan_hash_value bigint, child_number int, executions bigint, "
    "elapsed_time bigint, cpu_time bigint, user_io_wait_time bigint, disk_reads bigint, "
    "buffer_gets bigint, rows_processed bigint, sql_fulltext string",
    "sqlstats_delta": "sql_id string, plan_hash_value bigint, delta_execution_count bigint, "
    "delta_elapsed_time bigint, delta_cpu_time bigint, delta_user_io_wait_time bigint, "
    "delta_concurrency_time bigint, avg_hard_parse_time bigint, delta_disk_reads bigint, "
    "delta_buffer_gets bigint, delta_rows_processed bigint, delta_px_servers_executions bigint",
    "plan_line": _PLAN_LINE,
    "plan_line_hist": _PLAN_LINE,
    "plan_monitor": "sql_id string, sql_plan_hash_value bigint, sql_exec_id bigint, "
    "plan_line_id int, status string, sid bigint, sql_exec_start timestamp, "
    "first_refresh_time timestamp, last_refresh_time timestamp, starts bigint, "
    "output_rows bigint, physical_read_requests bigint, physical_write_requests bigint, "
    "physical_read_bytes bigint, physical_write_bytes bigint, workarea_max_mem bigint, "
    "workarea_max_tempseg bigint, plan_depth int, plan_operation string, plan_options string, "
    "plan_object_owner string, plan_object_name string, plan_object_type string, "
    "plan_cost bigint, plan_cardinality bigint, plan_bytes bigint",
    # job log
    "job_run": "dbid int, job_name string, session_id string, req_start_date timestamp, "
    "run_duration interval day to second, cpu_used interval day to second",
    "wr_control": "dbid int, snap_interval interval day to second, retention interval day to second",
    "parallel_task": "job_prefix string, task_name string, sql_stmt string",
    # catalog: indexes, tables, space
    "idx": "owner string, index_name string, table_owner string, table_name string, "
    "uniqueness string, partitioned string, num_rows bigint, distinct_keys bigint, "
    "blevel bigint, leaf_blocks bigint, pct_free bigint",
    "ind_column": "index_owner string, index_name string, column_name string",
    "ind_stat": "owner string, index_name string, partition_name string, num_rows bigint",
    "col_stat": "owner string, table_name string, column_name string, avg_col_len bigint, "
    "num_nulls bigint",
    "tbl": "owner string, table_name string, last_analyzed timestamp, monitoring string",
    "index_segment": "owner string, segment_name string, bytes bigint",
    "index_usage": "owner string, name string, last_used timestamp",
    "index_usage_info": "index_stats_enabled int, active_elem_count bigint",
    "object_usage": "index_name string, table_name string, monitoring string, used string, "
    "start_monitoring string",
    "tab_modification": "table_owner string, table_name string, partition_name string, "
    "modified_at timestamp, inserts bigint, updates bigint, deletes bigint",
    "constraint_def": "index_owner string, index_name string, constraint_type string",
    "data_file": "tablespace_name string, bytes bigint",
    "temp_file": "tablespace_name string, bytes bigint",
    "segment": "tablespace_name string, owner string, segment_name string, bytes bigint",
    "free_space": "tablespace_name string, bytes bigint",
    "extent": "file_id bigint, block_id bigint, extent_id bigint",
    "corruption": "file_id bigint, block_id bigint",
    # buffer content
    "buffer_header": "class_id int, status string, dirty string, temp string, ping string, "
    "stale string, direct string, new string, objd bigint",
    "object": "data_object_id bigint, object_name string",
    # parameters
    "param_def": "indx bigint, name string, description string",
    "param_session": "indx bigint, value string",
    "param_instance": "indx bigint, value string",
    # statistics upkeep, sessions, long operations
    "tab_statistic": "table_name string, stattype_locked string, last_analyzed timestamp",
    "user_tbl": "table_name string, temporary string",
    "mview_log": "log_table string",
    "session": "osuser string, action string, sid bigint",
    "longop": "sid bigint, serial_no bigint, sql_id string, opname string, sofar bigint, "
    "totalwork bigint, elapsed_time bigint, time_remaining bigint, message string",
    "active_now": "session_id bigint, session_serial bigint, sql_id string, "
    "top_level_sql_id string",
}

# The tables that grow with time; they are stored by the day of their snapshot.
FACTS = ("sqlstat", "ash", "sysstat")

# Logs kept for several databases, a folder each; the folder's name is a column of the key.
BY_DATABASE = ("job_run",)

# Tables whose reports return every column there is: the declared ones and those found in the files.
OPEN = ("sqltext", "extent", "session", "tab_statistic", "longop")
