"""The telemetry views over the given tables, in definition order."""

_REGION = "join nation on n_nationkey = {key} join region on r_regionkey = n_regionkey"

_INDEX_OWNER = "case when p_size <= 25 then 'OWN' else p_brand end"

VIEWS: dict[str, str] = {
    "measured": """
        select event_id, ts, user_id, event_type, 1 dbid,
            cast(1 + event_id % 2 as integer) instance_number,
            date_diff('hour', timestamp '2023-12-31 00:00:00', ts) snap_id,
            's' || (user_id % 20) sql_id,
            cast(case event_type when 'error' then 0 when 'click' then 101 when 'view' then 202
                when 'purchase' then 303 else 404 end as bigint) plan_hash_value,
            cast(round(value * 100) as bigint) * 10000 us
        from events""",
    "snapshot": """
        select 1 dbid, i.instance_number,
            date_diff('hour', timestamp '2023-12-31 00:00:00', h.b) snap_id,
            h.b begin_interval_time, h.b + interval 1 hour end_interval_time,
            timestamp '2023-12-31 00:00:00' startup_time
        from (select distinct date_trunc('hour', ts) b from events) h,
            (values (1), (2)) i(instance_number)""",
    "sqlstat": """
        select dbid, instance_number, snap_id, sql_id, plan_hash_value, min(event_type) module,
            sum(case when event_type = 'view' then 0 else 1 end) executions_delta,
            sum(us) elapsed_time_delta, sum(us % 900000) cpu_time_delta,
            sum(us % 800000) iowait_delta, sum(us % 500000) ccwait_delta,
            sum(us % 400000) apwait_delta, sum(us % 300000) plsexec_time_delta,
            sum(us % 200000) javexec_time_delta, sum(us % 700000) disk_reads_delta,
            sum(us % 600000) buffer_gets_delta, sum(event_id % 11) rows_processed_delta,
            sum(event_id % 7) parse_calls_delta, sum(event_id % 5) px_servers_execs_delta
        from measured group by all""",
    "ash": """
        select dbid, instance_number, snap_id, ts sample_time, user_id session_id,
            (user_id + case when event_id % 4 = 0 then 1 else 0 end) % 3 session_serial,
            sql_id, plan_hash_value sql_plan_hash_value,
            case when event_type <> 'error' then event_id % 5 end sql_exec_id,
            case when event_type <> 'error' then date_trunc('day', ts) end sql_exec_start,
            us tm_delta_db_time, us % 900000 tm_delta_cpu_time,
            us % 5000000 delta_read_io_bytes, us % 3000000 delta_write_io_bytes,
            case when event_id % 3 = 0 then 'Y' else 'N' end in_parse,
            case event_id % 5 when 0 then null when 1 then 'Y' else 'N' end in_hard_parse,
            case when event_type = 'click' then 'Y' else 'N' end in_sql_execution,
            case when event_id % 7 = 0 then 'Y' else 'N' end in_plsql_execution,
            case when event_type = 'signup' then null else 'N' end in_java_execution,
            case when event_id % 11 = 0 then 'Y' else 'N' end in_cursor_close
        from measured""",
    "sysstat": """
        select dbid, instance_number, snap_id,
            case event_type when 'signup' then 'logons current'
                when 'purchase' then 'Session Connect Time' else event_type end stat_name,
            sum(us) "value"
        from measured group by dbid, instance_number, snap_id, event_type""",
    "sqltext": """
        select 's' || p_partkey sql_id, p_size % 5 command_type,
            'select * from ' || replace(p_name, ' ', '_') || ' where x = 1' sql_text
        from part""",
    "command_name": """
        select distinct p_size % 5 command_type, 'CMD_' || (p_size % 5) command_name
        from part where p_size % 5 <> 4""",
    "job_run": """
        select 1 dbid, case when user_id % 7 = 0 then 'JOB_' || user_id
                else 'TASK$_' || (user_id % 30) || '_' || user_id end job_name,
            user_id || ',' || (user_id % 3) session_id,
            min(ts) req_start_date, max(ts) req_end_date, count(*) cpu_millis
        from events group by user_id, date_trunc('day', ts)""",
    "wr_control": """
        select r_regionkey + 1 dbid, to_days(30 - 10 * least(r_regionkey, 2)) retention
        from region""",
    "snapshot_two": """
        select * from snapshot
        union all
        select * replace (2 as dbid, begin_interval_time + interval 30 minute as begin_interval_time,
            end_interval_time + interval 30 minute as end_interval_time)
        from snapshot""",
    "ash_two": """
        select * from ash
        union all
        select * replace (2 as dbid, tm_delta_db_time * 2 as tm_delta_db_time)
        from ash where in_parse = 'N'""",
    "job_run_two": """
        select * from job_run
        union all
        select * replace (2 as dbid) from job_run where session_id like '%,1'""",
    "parallel_task": """
        select 'TASK$_' || n_nationkey job_prefix, n_name task_name, 'update ' || n_name sql_stmt
        from nation""",
    "sql_area": """
        select 's' || o_orderkey sql_id, 1000 + o_orderkey % 9973 plan_hash_value, 0 child_number,
            o_custkey % 9 executions,
            cast(round(o_totalprice * 100) as bigint) * 100 elapsed_time,
            cast(round(o_totalprice * 100) as bigint) * 70 cpu_time,
            cast(round(o_totalprice * 100) as bigint) user_io_wait_time,
            o_custkey * 3 disk_reads, o_custkey * 5 buffer_gets, o_custkey % 100 rows_processed,
            'select ' || o_orderpriority || ' from orders' sql_fulltext
        from orders""",
    "sqlstats_delta": """
        select case when o_orderstatus = 'P' then 'x' else 's' end || o_orderkey sql_id,
            1000 + o_orderkey % 9973 plan_hash_value,
            o_custkey % 17 delta_execution_count,
            cast(round(o_totalprice * 100) as bigint) * 10000 delta_elapsed_time,
            cast(round(o_totalprice * 100) as bigint) * 100 delta_cpu_time,
            cast(round(o_totalprice * 100) as bigint) delta_user_io_wait_time,
            o_custkey * 1000 delta_concurrency_time,
            case when o_orderstatus <> 'F' then o_custkey * 20000 end avg_hard_parse_time,
            o_custkey * 3 delta_disk_reads, o_custkey * 5 delta_buffer_gets,
            o_custkey % 100 delta_rows_processed, o_custkey % 4 delta_px_servers_executions
        from orders""",
    "plan_line": """
        select 's' || l_orderkey sql_id, 1000 + l_orderkey % 9973 plan_hash_value,
            cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey,
                l_suppkey, l_extendedprice, l_shipdate) - 1 as integer) id,
            l_linenumber % 4 depth, 'OP_' || l_returnflag operation,
            case when l_linestatus = 'F' then 'FULL' end options,
            case when l_suppkey % 2 = 0 then 'OWN' end object_owner,
            case when l_partkey % 3 <> 0 then
                case when l_returnflag = 'A' then 'IDX_' else 'PART_' end || l_partkey end
                object_name,
            case when l_returnflag = 'A' then 'INDEX (UNIQUE)' else 'TABLE' end object_type,
            case when l_linenumber = 1 then 'ALL_ROWS' end optimizer,
            cast(l_quantity as bigint) cost, l_partkey cardinality, l_suppkey bytes,
            cast(l_quantity as bigint) * 900 cpu_cost, cast(l_quantity as bigint) * 3 io_cost,
            case when l_returnflag = 'A' then 'K=' || l_partkey end access_predicates,
            case when l_returnflag = 'R' then 'V>' || l_suppkey end filter_predicates,
            'C' || l_linenumber projection
        from lineitem""",
    "plan_line_hist": """
        select * replace (plan_hash_value + 20000 as plan_hash_value,
            case when object_type = 'INDEX (UNIQUE)' and object_name is not null
                then 'IDX_' || (cardinality + 1) else object_name end as object_name)
        from plan_line""",
    "plan_monitor": """
        select sql_id, plan_hash_value sql_plan_hash_value,
            16777216 + plan_hash_value % 3 sql_exec_id,
            cast(case when cost > 10 or id = 0 then id else id + 1000 end as integer) plan_line_id,
            case when cost % 2 = 0 then 'DONE' else 'EXECUTING' end status, plan_hash_value sid,
            timestamp '2024-01-01 00:00:00' sql_exec_start,
            timestamp '2024-01-01 00:00:10' first_refresh_time,
            timestamp '2024-01-01 00:00:10' + to_seconds(cost) last_refresh_time,
            cost starts, cardinality output_rows,
            cost * 7 physical_read_requests, bytes * 11 physical_write_requests,
            cost * 57344 physical_read_bytes, bytes * 90112 physical_write_bytes,
            case when id > 1 then cost * 1024 end workarea_max_mem,
            case when id > 2 then cost * 2048 end workarea_max_tempseg,
            depth plan_depth, operation plan_operation, options plan_options,
            object_owner plan_object_owner, object_name plan_object_name,
            object_type plan_object_type, cost plan_cost, cardinality plan_cardinality,
            bytes plan_bytes
        from plan_line""",
    "idx": f"""
        select {_INDEX_OWNER} owner, 'IDX_' || p_partkey index_name, p_brand table_owner,
            p_type table_name,
            case when p_size % 2 = 0 then 'UNIQUE' else 'NONUNIQUE' end uniqueness,
            case when p_size > 40 then 'YES' else 'NO' end partitioned,
            cast(p_size as bigint) * 1000 num_rows, cast(p_size as bigint) * 10 distinct_keys,
            cast(p_size % 4 as bigint) blevel, cast(p_size as bigint) * 3 leaf_blocks,
            cast(10 as bigint) pct_free
        from part""",
    "ind_column": f"""
        select {_INDEX_OWNER} index_owner, 'IDX_' || p_partkey index_name, c.column_name
        from part join (values ('C1'), ('C2'), ('C3')) c(column_name)
            on p_size % 2 = 0 or c.column_name = 'C1'""",
    "ind_stat": """
        select owner, index_name, p.partition_name, num_rows
        from idx, (values (cast(null as varchar)), ('P1')) p(partition_name)""",
    "tbl": """
        select distinct table_owner owner, table_name, timestamp '2024-01-01 00:00:00' last_analyzed,
            'YES' monitoring
        from idx""",
    "col_stat": """
        select owner, table_name, 'C' || k column_name, k * 4 avg_col_len, k * 7 num_nulls
        from tbl, (values (cast(1 as bigint)), (2)) x(k)""",
    "index_segment": f"""
        select {_INDEX_OWNER} owner,
            case when p_size <= 45 then 'IDX_' else 'LOB_' end || p_partkey segment_name,
            cast(p_size as bigint) * 65536 bytes
        from part""",
    "index_usage": f"""
        select {_INDEX_OWNER} owner,
            case when p_size > 15 then 'IDX_' else 'GONE_' end || p_partkey "name",
            timestamp '2024-01-20 00:00:00' - to_days(p_size) last_used
        from part""",
    "index_usage_info": "select r_regionkey % 2 index_stats_enabled from region",
    "object_usage": """
        select case when p_type <> 'STANDARD' then 'IDX_' else 'GONE_' end || p_partkey index_name,
            p_type table_name,
            case when p_size % 3 = 0 then 'NO' else 'YES' end monitoring,
            case when p_size % 2 = 0 then 'YES' when p_size % 5 = 0 then 'NO' end used,
            '01/31/2024 23:59:58' start_monitoring
        from part""",
    "tab_modification": """
        select owner table_owner, table_name,
            case when table_name = 'PROMO' then 'P1' end partition_name,
            case table_name when 'SMALL' then last_analyzed
                when 'LARGE' then timestamp '2023-12-30 00:00:00'
                else timestamp '2024-01-03 00:00:00' end modified_at,
            cast(1000 as bigint) inserts, cast(200 as bigint) updates, cast(30 as bigint) deletes
        from tbl""",
    "constraint_def": f"""
        select {_INDEX_OWNER} index_owner,
            case when p_brand <> 'Brand#3' then 'IDX_' else 'GONE_' end || p_partkey index_name,
            case when p_size % 2 = 0 then 'P' else 'U' end constraint_type
        from part""",
    "data_file": f"""
        select r_name tablespace_name, (s_suppkey + 1) * 1048576 bytes
        from supplier {_REGION.format(key="s_nationkey")}""",
    "temp_file": """
        select 'TEMP_' || n_regionkey tablespace_name,
            cast(n_nationkey + 1 as bigint) * 1048576 bytes
        from nation""",
    "segment": f"""
        select case when r_name = 'EUROPE' then 'GONE' else r_name end tablespace_name,
            n_name owner, c_name segment_name,
            c_custkey % 97 * 8192 bytes
        from customer {_REGION.format(key="c_nationkey")}""",
    "free_space": f"""
        select case when r_name = 'ASIA' then 'GONE' else r_name end tablespace_name,
            s_suppkey * 24576 bytes
        from supplier {_REGION.format(key="s_nationkey")}""",
    "buffer_header": """
        select l_linenumber * 3 class_id, l_returnflag status, l_linestatus dirty,
            case when l_quantity > 45 then 'Y' else 'N' end "temp",
            case when l_linenumber <> 1 then 'N' end ping,
            case when l_quantity < 5 then 'Y' else 'N' end stale,
            'N' direct, 'N' "new", l_partkey objd
        from lineitem""",
    "object": "select p_partkey data_object_id, p_type object_name from part",
    "param_def": """
        select p_partkey indx, '_' || replace(p_name, ' ', '_') || '_stats' "name",
            p_type description
        from part""",
    "param_session": 'select p_partkey indx, p_brand "value" from part',
    "param_instance": """
        select p_partkey indx, 'Brand#' || (p_partkey % 25) "value" from part""",
    "extent": """
        select l_suppkey file_id, l_partkey block_id, l_orderkey extent_id from lineitem""",
    "corruption": """
        select distinct l_suppkey file_id, l_partkey block_id from lineitem where l_quantity = 50""",
    "session": """
        select c_mktsegment osuser, 'ELEMENT #' || c_custkey "action", c_custkey sid
        from customer""",
    "tab_statistic": """
        select case when p_size = 30 then 'ttx$' when p_size = 31 then 'TEMP_'
                when p_size = 32 then 'TEMPX' else 'T_' end || p_partkey ||
            case p_size % 6 when 0 then '_TEST' when 1 then 'XTEST' when 2 then '_tmp1'
                when 3 then '_OLD' else '' end table_name,
            case when p_brand = 'Brand#7' then 'ALL' end stattype_locked,
            timestamp '2022-09-09 12:34:56' + to_days(p_size - 45) last_analyzed
        from part""",
    "user_tbl": """
        select table_name, case when table_name like '%7' then 'Y' else 'N' end "temporary"
        from tab_statistic""",
    "mview_log": "select table_name log_table from tab_statistic where table_name like 'T%9'",
    "longop": """
        select user_id sid, user_id % 3 serial_no, 's' || (user_id % 20) sql_id,
            event_type opname, event_id % 50 sofar, cast(50 as bigint) totalwork,
            event_id % 90 elapsed_time, event_id % 7 time_remaining,
            event_type || ': ' || (event_id % 50) || ' out of 50' message
        from events""",
    "active_now": """
        select user_id session_id, event_id % 3 session_serial, 's' || (user_id % 20) sql_id,
            's' || (event_id % 40) top_level_sql_id
        from events""",
}
