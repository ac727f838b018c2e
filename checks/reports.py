"""The reports as DuckDB SQL over the views, written without the shapes the Spark side uses."""

import re

MICRO = 1_000_000
MIB = 1024 * 1024

# The 30 days before the report time 2024-01-31, both ends included.
IN_WINDOW = (
    "begin_interval_time between timestamp '2024-01-01 00:00:00' and timestamp '2024-01-31 00:00:00'"
)
STATS_START = "timestamp '2022-09-09 12:34:56'"


def rounded(num: str, den: str = "1", scale: int = 1, digits: int = 0) -> str:
    """round(num / den / scale, digits), ties away from zero, on 128-bit whole numbers."""
    num, bottom = f"cast({num} as hugeint)", f"(cast({den} as hugeint) * {scale})"
    size = f"(2 * abs({num}) * {10**digits} + abs({bottom})) // nullif(2 * abs({bottom}), 0)"
    whole = f"cast(sign({num}) * sign({bottom}) * ({size}) as bigint)"
    return f"{whole} / {float(10**digits)}" if digits else whole


def _at_least_one(executions: str) -> str:
    return f"case when {executions} is not null then greatest({executions}, 1) end"


_COUNTERS = {
    "ela": "elapsed_time_delta",
    "cpu": "cpu_time_delta",
    "io": "iowait_delta",
    "cc": "ccwait_delta",
    "app": "apwait_delta",
    "plsql": "plsexec_time_delta",
    "java": "javexec_time_delta",
    "disk": "disk_reads_delta",
    "lio": "buffer_gets_delta",
    "r": "rows_processed_delta",
    "pc": "parse_calls_delta",
    "px": "px_servers_execs_delta",
}
_TIMED = ("ela", "cpu", "io", "cc", "app", "plsql", "java")


def _costs(prefix: str, unit: int) -> str:
    runs = _at_least_one(f"sum({prefix}executions_delta)")
    columns = [f"cast(sum({prefix}executions_delta) as bigint) e"]
    for name, counter in _COUNTERS.items():
        total = f"sum({prefix}{counter})"
        timed = name in _TIMED
        columns.append(
            f"{rounded(total, runs, unit if timed else 1, 4 if timed else 0)} {name}"
        )
    return ", ".join(columns)


_SNAP = "using (dbid, instance_number, snap_id)"
_FLAGS = {
    "parse": "in_parse",
    "hard_parse": "in_hard_parse",
    "sql": "in_sql_execution",
    "plsql": "in_plsql_execution",
    "java": "in_java_execution",
    "cursor_close": "in_cursor_close",
}

_JOBS = """
    select j.dbid, regexp_extract(job_name, '^TASK\\$_\\d+') job_prefix, session_id,
        try_cast(split_part(session_id, ',', 1) as bigint) sid,
        try_cast(split_part(session_id, ',', 2) as bigint) serial,
        req_start_date, req_end_date,
        (select min(snap_id) from snapshot s where s.dbid = j.dbid
            and req_start_date between begin_interval_time and end_interval_time) start_snap,
        (select min(snap_id) from snapshot s where s.dbid = j.dbid
            and req_end_date between begin_interval_time and end_interval_time) stop_snap
    from job_run j
    where regexp_matches(job_name, '^TASK\\$_\\d+_\\d+$')"""

_SAMPLED = """
    jobs left join ash on ash.dbid = jobs.dbid
        and ash.snap_id between jobs.start_snap and jobs.stop_snap
        and ash.session_id = jobs.sid and ash.session_serial = jobs.serial"""

_ATTRIBUTED = f"""
    coalesce(cast(min(start_snap) as varchar), '') || '-' ||
        coalesce(cast(max(stop_snap) as varchar), '') range_snap,
    count(distinct nullif(coalesce(cast(sql_exec_id as varchar), '') ||
        coalesce(strftime(sql_exec_start, '%Y%m%d%H:%M:%S'), ''), '')) unq_run,
    count(*) "rowcount",
    {rounded("sum(tm_delta_db_time)", "1", MICRO)} db_time,
    {rounded("sum(tm_delta_cpu_time)", "1", MICRO)} cpu_time"""


#: Jobs that began within the time their database keeps, and a day before it.
_KEPT = """req_start_date >= timestamp '2024-01-31 00:00:00' - interval 1 day -
                (select min(c.retention) from wr_control c where c.dbid = j.dbid)"""

#: The same over the tables with a second database.
_TWO = {"job_run": "job_run_two", "ash": "ash_two", "snapshot": "snapshot_two"}


def _of_two(sql: str) -> str:
    return re.sub(r"\b(job_run|ash|snapshot)\b(?!\.)", lambda m: _TWO[m[0]] + (" ash" if m[0] == "ash" else ""), sql)


def _seconds(start: str, stop: str) -> str:
    return f"(epoch_us({stop}) - epoch_us({start})) / 1e6"


_GROUPS = f"""
    with runs as (
        select *, regexp_extract(job_name, '^TASK\\$_\\d+') job_prefix,
            {_seconds("req_start_date", "req_end_date")} duration
        from job_run j where regexp_matches(job_name, '^TASK\\$_\\d+_\\d+$') and {_KEPT}),
    groups as (
        select dbid, job_prefix, count(distinct job_name) job_count,
            date_trunc('second', min(req_start_date)) job_start_date,
            min(duration) min_duration, max(duration) max_duration,
            min(cpu_millis) * 1000 / 1e6 min_cpu_used, max(cpu_millis) * 1000 / 1e6 max_cpu_used
        from runs group by dbid, job_prefix)
    select g.*, t.task_name, t.sql_stmt
    from groups g left join parallel_task t on t.job_prefix = g.job_prefix"""

_ATTRIBUTION = f"""
    with jobs as ({_JOBS} and job_name like 'TASK$_%')
    select jobs.dbid, jobs.job_prefix, ash.sql_id, {_ATTRIBUTED}
    from {_SAMPLED}
    group by grouping sets ((jobs.dbid, jobs.job_prefix, ash.sql_id), ())"""

_ALL_JOBS = f"""
    with listed as ({_JOBS} and {_KEPT}),
    sizes as (
        select dbid, job_prefix, count(distinct session_id) job_count from listed group by all),
    jobs as (select * from listed join sizes using (dbid, job_prefix))
    select jobs.dbid, jobs.job_prefix, jobs.job_count, min(req_start_date) min_start_date,
        max({_seconds("req_start_date", "req_end_date")}) max_duration,
        ash.sql_id, {_ATTRIBUTED}
    from {_SAMPLED}
    group by jobs.dbid, jobs.job_prefix, jobs.job_count, ash.sql_id
    having sum(tm_delta_db_time) is not null"""


def _cat(*parts: str) -> str:
    return " || ".join(p if p.startswith("'") else f"coalesce(cast({p} as varchar), '')" for p in parts)


def _short(counter: str) -> str:
    """Seconds with up to two decimals, without trailing zeros."""
    cents = rounded(counter, "1", MICRO // 100)
    return (
        f"case when ({cents}) % 100 = 0 then cast(({cents}) // 100 as varchar) "
        f"when ({cents}) % 10 = 0 then ({cents}) // 100 || '.' || (({cents}) % 100) // 10 "
        f"else ({cents}) // 100 || '.' || lpad(cast(({cents}) % 100 as varchar), 2, '0') end"
    )


def _long(counter: str) -> str:
    """Seconds with two decimals and blanks between thousands."""
    cents = rounded(counter, "1", MICRO // 100)
    return (
        f"replace(format('{{:,}}', ({cents}) // 100), ',', ' ') || '.' || "
        f"lpad(cast(({cents}) % 100 as varchar), 2, '0')"
    )


def _step(p: str, optimizer: bool) -> str:
    chosen = f"coalesce('  Optimizer=' || {p}optimizer, '') || " if optimizer else ""
    return f"""
        repeat(' ', cast(4 * {p}depth as bigint)) || {p}operation || {chosen}
        coalesce(' (' || {p}options || ')', '') ||
        coalesce(' OF ''' || coalesce({p}object_owner || '.', '') || {p}object_name || '''', '') ||
        case when {p}object_type = 'INDEX (UNIQUE)' then ' (UNIQUE)' else '' end ||
        '  (Cost=' || {p}cost || ' Card=' || {p}cardinality || ' Bytes=' || {p}bytes || ')'"""


def _header(child: bool) -> str:
    own = ["', cn = '", "s.child_number", "', e = '", "s.executions"] if child else []
    return _cat(
        "'SQL_ID = '",
        "s.sql_id",
        "', hv = '",
        "s.plan_hash_value",
        *own,
        "', ela = '",
        _short("s.elapsed_time"),
        "', cpu = '",
        _short("s.cpu_time"),
        "', io = '",
        _short("s.user_io_wait_time"),
        "', disk = '",
        "s.disk_reads",
        "', lio = '",
        "s.buffer_gets",
        "', r = '",
        "s.rows_processed",
    )


_ESTIMATE = "(i.num_rows * 1200 + rowset * (100 + i.pct_free))"

_INDEX_USAGE = f"""
    with sized as (
        select i.owner index_owner, i.index_name, i.uniqueness, i.table_owner, i.table_name,
            t.last_analyzed, t.monitoring,
            {rounded("sum(s.bytes)", "1", MIB, 3)} index_total_mb
        from idx i
            join tbl t on t.owner = i.table_owner and t.table_name = i.table_name
            join index_segment s on s.owner = i.owner and s.segment_name = i.index_name
        {{kept}}
        group by all)
    select z.index_owner, z.index_name, z.table_name, z.uniqueness, c.constraint_type,
        z.index_total_mb, z.monitoring tbl_monitoring, o.monitoring idx_monitoring,
        o.used index_used,
        strptime(o.start_monitoring, '%m/%d/%Y %H:%M:%S') start_index_monitoring,
        u.last_used last_index_used, z.last_analyzed, m.modified_at last_data_modification,
        m.inserts, m.updates, m.deletes,
        {rounded(
            "(m.inserts + m.updates + m.deletes) * 60000000",
            "(epoch_us(m.modified_at) - epoch_us(z.last_analyzed))",
        )} row_modified_per_minute
    from sized z
        left join index_usage u on u.owner = z.index_owner and u.name = z.index_name
        left join object_usage o
            on o.index_name = z.index_name and o.table_name = z.table_name
        left join tab_modification m on m.table_owner = z.table_owner
            and m.table_name = z.table_name and m.partition_name is null
        left join constraint_def c
            on c.index_owner = z.index_owner and c.index_name = z.index_name
    {{unused}}"""


def _daily(stat: str, column: str, scale: int) -> str:
    return f"""
        select date_trunc('day', n.begin_interval_time) date_calc, s.stat_name,
            {rounded('sum(s."value")', "1", scale)} {column}
        from sysstat s join snapshot n {_SNAP}
        where lower(s.stat_name) = '{stat}'
            and n.begin_interval_time > n.startup_time
            and n.end_interval_time < date_trunc('day', n.begin_interval_time) + interval 1 day
        group by 1, 2"""


# The given tables in the order they are read, with the columns that identify their rows.
_IDENTIFIED = {
    "region": "r_regionkey",
    "nation": "n_nationkey",
    "customer": "c_custkey",
    "supplier": "s_suppkey",
    "part": "p_partkey",
    "orders": "o_orderkey",
    "lineitem": None,
    "events": "event_id",
    "documents": "doc_id",
    "embeddings": "vec_id",
    "pages": "page_id",
    "benchmark": "item_id",
    "labels": "doc_id",
    "conversations": "conv_id, turn",
}


def _validated(position: int, table: str, keys: str | None) -> str:
    label = f"TABLE GIVEN.{table}"
    null_keys = repeated = "cast(null as bigint)"
    if keys:
        absent = " or ".join(f"{k.strip()} is null" for k in keys.split(","))
        null_keys = f"count(*) filter (where {absent})"
        repeated = f"(count(*) - {null_keys} - count(distinct ({keys})) filter (where not ({absent})))"
    return f"""
        select "position", owner, object_name, object_type, num_rows, null_keys, duplicate_keys,
            case when null_keys + duplicate_keys > 0 then 'FAILED' else 'OK' end status,
            case when null_keys + duplicate_keys > 0 then '{label} has ' || null_keys ||
                    ' rows with a NULL key and ' || duplicate_keys || ' repeated keys'
                else '{label} successfully validated' end message
        from (select 'ELEMENT #{position} of {len(_IDENTIFIED)}: GIVEN.{table} (TABLE)' "position",
            'GIVEN' owner, '{table}' object_name, 'TABLE' object_type, count(*) num_rows,
            {null_keys} null_keys, {repeated} duplicate_keys from {table})"""


def _column_profile(table: str, column: str, width: int | str | None, distinct: bool = True) -> str:
    """One column's row; a width given as text is that of an array's bytes, which has no limits."""
    size = f"case when {column} is null then 0 else {width or f'strlen({column})'} end"
    limits = [f"cast({f}({column}) as varchar)" if not isinstance(width, str) else "cast(null as varchar)" for f in ("min", "max")]
    return f"""
        select 'GIVEN' "owner", '{table}' table_name, '{column}' column_name, count(*) num_rows,
            count(*) - count({column}) num_nulls,{f" count(distinct {column}) num_distinct," if distinct else ""}
            {rounded(f"sum({size})", "count(*)")} avg_col_len,
            {limits[0]} min_value, {limits[1]} max_value,
            timestamp '2024-01-31 00:00:00' last_analyzed
        from {table}"""


def _indexed(columns: list[str]) -> str:
    return " or ".join(f"{c} is not null" for c in columns)


def _index_row(name: str, table: str, columns: list[str], unique: bool = False, pct_free: int = 10) -> str:
    return f"""
        select 'GIVEN' "owner", '{name}' index_name, 'GIVEN' table_owner, '{table}' table_name,
            '{"UNIQUE" if unique else "NONUNIQUE"}' uniqueness, 'NO' partitioned,
            (select count(*) from {table} where {_indexed(columns)}) num_rows,
            (select count(*) from (select distinct {", ".join(columns)} from {table} where {_indexed(columns)})) distinct_keys,
            cast(null as bigint) blevel, cast(null as bigint) leaf_blocks, cast({pct_free} as bigint) pct_free"""


def _index_size_row(name: str, table: str, columns: list[str], pct_free: int = 10) -> str:
    widths = {c: _PROFILED[table][c] or f"coalesce(strlen({c}), 0)" for c in columns}
    lengths = ", ".join(rounded(f"sum(case when {c} is null then 0 else {w} end)", "count(*)") + f" w{k}" for k, (c, w) in enumerate(widths.items()))
    nulls = ", ".join(f"count(*) - count({c}) u{k}" for k, c in enumerate(columns))
    rowset = " + ".join(f"(n - u{k}) * w{k}" for k in range(len(columns)))
    estimate = f"(n * 1200 + ({rowset}) * {100 + pct_free})"
    return f"""
        select 'GIVEN' index_owner, '{name}' index_name, 'NO' partitioned, n num_rows, d distinct_keys,
            {" + ".join(f"w{k}" for k in range(len(columns)))} avg_row_len,
            cast(null as bigint) blevel, cast(null as bigint) leaf_blocks,
            {rounded("n * 40", "1", MIB, 3)} allocated_for_segment_mb,
            {rounded(f"n * ({' + '.join(f'w{k}' for k in range(len(columns)))})", "1", MIB, 3)} used_by_data_mb,
            {rounded(estimate, "100", MIB, 3)} estimated_index_size_mb,
            {rounded(estimate, "(n * 40)", 1, 2)} pct_used
        from (select {lengths}, {nulls}, count(*) filter (where {_indexed(columns)}) n from {table}),
            (select count(*) d from (select distinct {", ".join(columns)} from {table} where {_indexed(columns)}))"""


_INDEXES = (
    ("LINEITEM_LINE", "lineitem", ["l_orderkey", "l_linenumber"]),
    ("LINEITEM_PART", "lineitem", ["l_partkey", "l_suppkey"]),
    ("LINEITEM_STATE", "lineitem", ["l_returnflag", "l_linestatus", "l_shipdate"]),
    ("LINEITEM_PRICE", "lineitem", ["l_extendedprice"]),
    ("ORDERS_PK", "orders", ["o_orderkey"]),
    ("ORDERS_CUSTOMER", "orders", ["o_custkey", "o_orderdate"]),
    ("DOCUMENTS_TEXT", "documents", ["lang", "text"]),
)
_FREE = {"LINEITEM_PRICE": 0}


_EXCLUDED = f"""
        select u.table_name from user_tbl u join tab_statistic s on s.table_name = u.table_name
        where s.stattype_locked is null and (
            s.last_analyzed >= {STATS_START} or u."temporary" = 'Y'
            or u.table_name in (select log_table from mview_log)
            or regexp_matches(upper(u.table_name), '^(TTX\\$|TDS\\$|TUP\\$|TEMP_|TMP_)')
            or regexp_matches(upper(u.table_name), '_(TEST|TEMP|TMP|OLD)'))"""

# Column widths in bytes; None is text, measured by its UTF-8 bytes, text an expression for the bytes.
_PROFILED = {
    "region": {"r_regionkey": 4, "r_name": None},
    "nation": {"n_nationkey": 4, "n_name": None, "n_regionkey": 4},
    "customer": {
        "c_custkey": 8, "c_name": None, "c_nationkey": 4, "c_acctbal": 8, "c_mktsegment": None,
    },
    "supplier": {"s_suppkey": 8, "s_name": None, "s_nationkey": 4, "s_acctbal": 8},
    "part": {
        "p_partkey": 8, "p_name": None, "p_brand": None, "p_type": None, "p_size": 4,
        "p_retailprice": 8,
    },
    "orders": {
        "o_orderkey": 8, "o_custkey": 8, "o_orderstatus": None, "o_totalprice": 8, "o_orderdate": 8,
        "o_orderpriority": None,
    },
    "lineitem": {
        "l_orderkey": 8, "l_partkey": 8, "l_suppkey": 8, "l_linenumber": 4, "l_quantity": 8,
        "l_extendedprice": 8, "l_discount": 8, "l_tax": 8, "l_returnflag": None,
        "l_linestatus": None, "l_shipdate": 8,
    },
    "events": {
        "event_id": 8, "ts": 8, "user_id": 8, "event_type": None, "value": 8, "props": None,
    },
    "documents": {"doc_id": 8, "text": None, "lang": None, "source": None, "n_chars": 8},
    "embeddings": {"vec_id": 8, "embedding": "4 * len(embedding)", "label": 4},
    "pages": {"page_id": 8, "url": None, "html": None},
    "benchmark": {"item_id": 8, "text": None},
    "labels": {"doc_id": 8, "quality": 4, "toxic": 4},
    "conversations": {"conv_id": 8, "turn": 8, "role": None, "text": None},
}


def _profiled(distinct: bool) -> str:
    return " union all ".join(
        _column_profile(table, column, width, distinct)
        for table, columns in _PROFILED.items()
        for column, width in columns.items()
    )


REPORTS: dict[str, str] = {
    "sql_common_info": """
        select c.command_name, t.sql_id,
            (select count(distinct s.plan_hash_value) from sqlstat s where s.sql_id = t.sql_id)
                plan_loaded,
            t.sql_text
        from sqltext t join command_name c on c.command_type = t.command_type""",
    "sql_text": "select sql_id, sql_text from sqltext",
    "sql_text_all_columns": "select * from sqltext",
    "sql_stats_daily": f"""
        select s.sql_id sqlid, s.plan_hash_value phv,
            date_trunc('day', n.begin_interval_time) tl, {_costs("s.", MICRO)}
        from sqlstat s join snapshot n {_SNAP}
        where n.{IN_WINDOW}
        group by 1, 2, 3""",
    "sql_executions": f"""
        select a.sql_id, a.sql_plan_hash_value plan_hash_value, a.sql_exec_id,
            a.session_id || ',' || a.session_serial sid_serial,
            min(n.snap_id) || ' - ' || max(n.snap_id) snap_range,
            a.sql_exec_start, date_trunc('second', max(a.sample_time)) sql_exec_stop,
            {rounded("sum(a.tm_delta_db_time)", "1", MICRO, 2)} db_time,
            {rounded("sum(a.tm_delta_cpu_time)", "1", MICRO, 2)} cpu_time,
            {rounded("sum(a.delta_read_io_bytes)", "1", MIB)} "read",
            {rounded("sum(a.delta_write_io_bytes)", "1", MIB)} "write",
            count(*) wait_count,
            {", ".join(f"count(*) filter (a.{f} <> 'N') {n}" for n, f in _FLAGS.items())}
        from ash a join snapshot n {_SNAP}
        where n.{IN_WINDOW}
        group by a.sql_id, a.sql_plan_hash_value, a.sql_exec_id, a.session_id,
            a.session_serial, a.sql_exec_start""",
    "monitor_executions": f"""
        select status, sid, sql_exec_id, sql_exec_start, sql_id, sql_plan_hash_value, output_rows,
            {_seconds("sql_exec_start", "last_refresh_time")} ela
        from plan_monitor where plan_line_id = 0""",
    "monitor_executions_with_text": f"""
        select m.status, m.sid, m.sql_exec_id, m.sql_exec_start, m.sql_id, m.sql_plan_hash_value,
            m.output_rows, {_seconds("m.sql_exec_start", "m.last_refresh_time")} ela,
            (select s.sql_fulltext from sql_area s where s.sql_id = m.sql_id
                and s.plan_hash_value = m.sql_plan_hash_value) sqltext
        from plan_monitor m where m.plan_line_id = 0""",
    "monitor_rows": "select * from plan_monitor",
    "plan_stats": f"""
        select s.sql_id, s.plan_hash_value, cast(sum(s.executions_delta) as bigint) e,
            {rounded(
                "sum(s.elapsed_time_delta)", _at_least_one("sum(s.executions_delta)"), MICRO, 4
            )} ela
        from snapshot n join sqlstat s {_SNAP}
        where n.{IN_WINDOW}
        group by 1, 2""",
    "plan_stats_ash": f"""
        with per_execution as (
            select s.sql_id, s.plan_hash_value, sum(a.tm_delta_db_time) db_time
            from sqlstat s join snapshot n {_SNAP}
                join ash a on a.dbid = s.dbid and a.instance_number = s.instance_number
                    and a.snap_id = s.snap_id and a.sql_id = s.sql_id
                    and a.sql_plan_hash_value = s.plan_hash_value
            where n.{IN_WINDOW}
            group by s.sql_id, s.plan_hash_value, a.sql_exec_id, a.sql_exec_start)
        select sql_id, plan_hash_value,
            {rounded("sum(db_time)", "count(db_time)", 1000)} avg_ms,
            cast(round(coalesce(stddev_samp(db_time), 0) / 1e3) as bigint) stddev_ms,
            {rounded("min(db_time)", "1", 1000)} min_ms,
            {rounded("max(db_time)", "1", 1000)} max_ms, count(*) sqlexec
        from per_execution group by 1, 2""",
    "multi_plan_queries": f"""
        with stat as (
            select s.*, n.begin_interval_time
            from snapshot n join sqlstat s {_SNAP}
            where n.{IN_WINDOW} and s.plan_hash_value <> 0),
        per_plan as (
            select sql_id, plan_hash_value,
                {rounded(
                    "sum(elapsed_time_delta)", _at_least_one("sum(executions_delta)"), MICRO, 4
                )} ela
            from stat group by 1, 2)
        select st.sql_id, count(distinct st.plan_hash_value) loaded_plans,
            date_trunc('second', max(st.begin_interval_time)) last_load_time,
            min(p.ela) min_elapsed, max(p.ela) max_elapsed,
            case when min(p.ela) = 0 then 0 else {rounded(
                "round((max(p.ela) - min(p.ela)) * 10000) * 100", "round(min(p.ela) * 10000)"
            )} end percent
        from stat st left join per_plan p on p.sql_id = st.sql_id
        group by st.sql_id having count(distinct st.plan_hash_value) > 1""",
    "queries_by_text": f"""
        with queries as (
            select sql_id, sql_text from sqltext
            where upper(sql_text) like '%RED_WIDGET%' or upper(sql_text) like '%BLUE_BOLT%'),
        stat as (
            select q.sql_id sqlid, date_trunc('day', n.begin_interval_time) tl,
                q.sql_text, s.*,
                dense_rank() over (partition by s.sql_id
                    order by date_trunc('day', n.begin_interval_time) desc nulls first) drnk
            from queries q left join sqlstat s on s.sql_id = q.sql_id
                left join snapshot n on n.dbid = s.dbid
                    and n.instance_number = s.instance_number and n.snap_id = s.snap_id)
        select sqlid, tl, {_costs("", 1000)}, module, sql_text
        from stat where drnk = 1 group by sqlid, module, sql_text, tl""",
    "job_group_summary": _GROUPS,
    "job_group_summary_databases": _of_two(_GROUPS),
    "job_sql_attribution": _ATTRIBUTION,
    "job_sql_attribution_databases": _of_two(_ATTRIBUTION),
    "job_sql_attribution_all": _ALL_JOBS,
    "job_sql_attribution_all_databases": _of_two(_ALL_JOBS),
    "index_size_estimate": f"""
        select i.owner index_owner, i.index_name, i.partitioned, i.num_rows, i.distinct_keys,
            a.avg_row_len, i.blevel, i.leaf_blocks,
            {rounded("s.bytes", "1", MIB, 3)} allocated_for_segment_mb,
            {rounded("i.num_rows * a.avg_row_len", "1", MIB, 3)} used_by_data_mb,
            {rounded(_ESTIMATE, "100", MIB, 3)} estimated_index_size_mb,
            {rounded(_ESTIMATE, "s.bytes", 1, 2)} pct_used
        from idx i join index_segment s on s.owner = i.owner and s.segment_name = i.index_name
            left join lateral (
                select cast(sum(cs.avg_col_len) as bigint) avg_row_len,
                    cast(sum((st.num_rows - cs.num_nulls) * cs.avg_col_len) as bigint) rowset
                from ind_column ic
                    join ind_stat st on st.owner = ic.index_owner and st.index_name = ic.index_name
                        and st.partition_name is null
                    join col_stat cs on cs.column_name = ic.column_name
                    join tbl t on t.owner = cs.owner and t.table_name = cs.table_name
                where ic.index_owner = i.owner and ic.index_name = i.index_name
                    and t.owner = i.table_owner and t.table_name = i.table_name
            ) a on true""",
    "index_usage": _INDEX_USAGE.format(kept="", unused=""),
    "index_usage_not_in_plans": _INDEX_USAGE.format(
        kept="""where not exists (select 1 from plan_line p
            where p.object_owner = i.owner and p.object_name = i.index_name)
            and not exists (select 1 from plan_line_hist p
            where p.object_owner = i.owner and p.object_name = i.index_name)""",
        unused="",
    ),
    "index_usage_unused_uncollected": _INDEX_USAGE.format(
        kept="",
        unused="""where (o.used is null and o.monitoring = 'YES')
            or u.last_used <= timestamp '2024-01-31 00:00:00' - interval 30 day""",
    ),
    "index_usage_unused": _INDEX_USAGE.format(
        kept="",
        unused="""where (o.used is null and o.monitoring = 'YES')
            or (u.last_used is null
                and exists (select 1 from index_usage_info where index_stats_enabled = 1))
            or u.last_used <= timestamp '2024-01-31 00:00:00' - interval 30 day""",
    ),
    "plan_monitor_report": f"""
        select m.sql_id, m.sql_plan_hash_value, m.sql_exec_id,
            case when h.kind = 0 then null else m.plan_line_id end id,
            case when h.pos = 0 then {_cat(
                "'SQL_ID = '", "m.sql_id", "', phv = '", "m.sql_plan_hash_value", "', eid = '",
                "m.sql_exec_id",
            )}
            when h.pos = 1 then (select {_cat(
                "'SQLSTAT: , e = '", "s.delta_execution_count",
                "', ela = '", _long("s.delta_elapsed_time"),
                "', cpu = '", _long("s.delta_cpu_time"),
                "', io = '", _long("s.delta_user_io_wait_time"),
                "', cc = '", _long("s.delta_concurrency_time"),
                "', parse = '", _long("s.avg_hard_parse_time"),
                "', disk = '", "s.delta_disk_reads", "', lio = '", "s.delta_buffer_gets",
                "', r = '", "s.delta_rows_processed", "', px = '", "s.delta_px_servers_executions",
            )} from sqlstats_delta s
                where s.sql_id = m.sql_id and s.plan_hash_value = m.sql_plan_hash_value)
            else {_step("m.plan_", False)} end sqlplan,
            m.starts, m.output_rows a_rows,
            {_seconds("m.first_refresh_time", "m.last_refresh_time")} a_time,
            m.physical_read_requests + m.physical_write_requests rwreq,
            m.physical_read_bytes + m.physical_write_bytes rwbyt,
            m.workarea_max_mem max_mem, m.workarea_max_tempseg max_temp
        from plan_monitor m
            left join (values (0, 0), (1, 0), (2, 1)) h(pos, kind) on h.kind >= m.plan_line_id""",
    "plan_tree": f"""
        select p.sql_id, p.plan_hash_value, case when h.kind = 0 then null else p.id end id,
            case when h.kind = 0 then {_header(True)} else {_step("p.", True)} end sqlplan,
            p.access_predicates, p.filter_predicates
        from sql_area s
            join plan_line p on p.sql_id = s.sql_id and p.plan_hash_value = s.plan_hash_value
            left join (values (0), (1)) h(kind) on h.kind >= p.id
        where s.child_number = 0""",
    "plan_tree_with_actuals": f"""
        select p.sql_id, p.plan_hash_value, m.sql_exec_id,
            case when h.kind = 0 then null else p.id end id,
            case when h.kind = 0 then {_header(False)} else {_step("p.", True)} end sqlplan,
            m.starts, m.output_rows,
            m.physical_read_requests + m.physical_write_requests rwreq,
            m.physical_read_bytes + m.physical_write_bytes rwbyt,
            m.workarea_max_mem max_mem, m.workarea_max_tempseg max_temp,
            p.access_predicates, p.filter_predicates, p.projection
        from sql_area s
            join plan_line p on p.sql_id = s.sql_id and p.plan_hash_value = s.plan_hash_value
            left join plan_monitor m on m.sql_id = p.sql_id
                and m.sql_plan_hash_value = p.plan_hash_value and m.plan_line_id = p.id
            left join (values (0), (1)) h(kind) on h.kind >= p.id""",
    "plan_lines": """
        select sql_id, plan_hash_value, id, repeat(' ', depth) || operation operation, options,
            object_owner, object_name, object_type, optimizer, cost, cardinality, bytes,
            cpu_cost, io_cost, access_predicates, filter_predicates
        from plan_line""",
    "plan_lines_hist": """
        select sql_id, plan_hash_value, id, repeat(' ', depth) || operation operation, options,
            object_owner, object_name, object_type, optimizer, cost, cardinality, bytes,
            cpu_cost, io_cost, access_predicates, filter_predicates
        from plan_line_hist""",
    "tablespace_usage": f"""
        with total as (
            select tablespace_name, {rounded("sum(bytes)", "1", MIB)} mb
            from data_file group by 1),
        used as (
            select tablespace_name, {rounded("sum(bytes)", "1", MIB)} mb
            from segment group by 1)
        select t.tablespace_name tablespace, u.mb used_mb, t.mb - u.mb free_mb, t.mb total_mb,
            {rounded("100 * (t.mb - u.mb)", "t.mb")} pct_free
        from total t join used u on u.tablespace_name = t.tablespace_name""",
    "tablespace_free": f"""
        with sizes as (
            select tablespace_name, sum(bytes) / {float(MIB)} size_mb from data_file group by 1
            union
            select tablespace_name, sum(bytes) / {float(MIB)} from temp_file group by 1)
        select z.tablespace_name, z.size_mb, f.free_mb
        from sizes z left join (
            select tablespace_name, {rounded("sum(bytes)", "1", MIB, 2)} free_mb
            from free_space group by 1) f on f.tablespace_name = z.tablespace_name""",
    "buffer_summary": """
        with labels(class_id, block_class) as (values
            (1, 'data block'), (2, 'sort block'), (3, 'save undo block'), (4, 'segment header'),
            (5, 'save undo header'), (6, 'free list'), (7, 'extent map'), (8, '1st level bmb'),
            (9, '2nd level bmb'), (10, '3rd level bmb'), (11, 'bitmap block'),
            (12, 'bitmap index block'), (13, 'file header block'), (14, 'unused'),
            (15, 'system undo header'), (16, 'system undo block'), (17, 'undo header'),
            (18, 'undo block')),
        cached as (
            select o.object_name, l.block_class, b.status, b.dirty, b."temp", b.ping, b.stale,
                b.direct, b."new"
            from buffer_header b join object o on o.data_object_id = b.objd
                left join labels l on l.class_id = b.class_id)
        select c.*, count(*) blkcount,
            (select count(*) from cached x where x.object_name = c.object_name) blkcount_total
        from cached c group by all""",
    "parameter_values": """
        select d."name" "parameter", d.description, s."value" session_value,
            i."value" instance_value
        from param_def d, param_session s, param_instance i
        where d.indx = s.indx and d.indx = i.indx""",
    "parameter_values_like": """
        select d."name" "parameter", d.description, s."value" session_value,
            i."value" instance_value
        from param_def d, param_session s, param_instance i
        where d.indx = s.indx and d.indx = i.indx and d."name" like '/_%red%stats%' escape '/'""",
    "daily_logons": _daily("logons current", "number_of_logons", 1),
    "daily_connect_time": _daily("session connect time", "session_connect_time", MICRO),
    "corrupt_extents": """
        select e.* from extent e where exists (
            select 1 from corruption c where c.file_id = e.file_id and c.block_id = e.block_id)""",
    "sessions_for_user": """
        select "action", osuser, "action" action_1, sid from session where osuser = 'BUILDING'""",
    "locked_stats": "select * from tab_statistic where stattype_locked is not null",
    "pending_stats": f"""
        select * from tab_statistic
        where stattype_locked is null and last_analyzed <= {STATS_START}""",
    "stats_exclusions": _EXCLUDED,
    "gather_exclusions": f"""
        select table_name from tab_statistic where stattype_locked is not null
        union
        {_EXCLUDED}""",
    "long_operations": "select * from longop where opname = 'click'",
    "long_operations_running": """
        select l.* from longop l
        where l.time_remaining > 0 and exists (
            select 1 from active_now a
            where a.session_id = l.sid and a.session_serial = l.serial_no and a.sql_id = l.sql_id
                and a.top_level_sql_id in (select sql_id from longop where opname = 'click'))""",
    "table_profile": _profiled(distinct=True),
    "table_profile_merged": _profiled(distinct=False),
    "index_profile": " union all ".join(
        _index_row(name, table, columns, name == "ORDERS_PK", _FREE.get(name, 10)) for name, table, columns in _INDEXES
    ),
    "index_size_estimate_profiled": " union all ".join(
        _index_size_row(name, table, columns, _FREE.get(name, 10)) for name, table, columns in _INDEXES
    ),
    "validate_index": """
        with entries as (
            select o_orderkey, o_custkey + case when o_orderkey % 107 = 0 and o_orderkey % 103 <> 0 then 1 else 0 end o_custkey,
                o_orderdate
            from orders where o_orderkey % 101 <> 0
            union all
            select case when o_orderkey % 103 = 0 then o_orderkey else -o_orderkey end, o_custkey, o_orderdate
            from orders where o_orderkey % 101 <> 0
                and (o_orderkey % 103 = 0 or (o_orderkey % 109 = 0 and o_orderkey % 107 <> 0))),
        sides as (
            select o_orderkey, o_custkey, o_orderdate, 1 t, 0 i from orders
            union all
            select o_orderkey, o_custkey, o_orderdate, 0, 1 from entries),
        alike as (select o_orderkey, o_custkey, o_orderdate, sum(t) t, sum(i) i from sides group by all having sum(t) <> sum(i))
        select o_orderkey,
            case when max(t - i) > 0 and max(case when t = 0 then i else 0 end) > 0 then 'changed'
                when max(t - i) > 0 then 'lost' when max(case when t = 0 then i else 0 end) > 0 then 'stray'
                else 'doubled' end verdict,
            cast(sum(greatest(t - i, 0)) as bigint) rows_without_entry,
            cast(sum(greatest(i - t, 0)) as bigint) entries_without_row
        from alike group by o_orderkey""",
    "validate_tables": " union all ".join(
        _validated(i, table, keys) for i, (table, keys) in enumerate(_IDENTIFIED.items(), start=1)
    ),
}

# Reports with other parameters.
REPORTS["index_size_estimate_of"] = REPORTS["index_size_estimate"] + " where i.owner = 'OWN'"
REPORTS["queries_by_literal_text"] = (
    REPORTS["queries_by_text"]
    .replace("upper(sql_text) like '%RED_WIDGET%'", "contains(upper(sql_text), 'RED_WIDGET')")
    .replace("upper(sql_text) like '%BLUE_BOLT%'", "contains(upper(sql_text), 'BLUE_BOLT')")
)
