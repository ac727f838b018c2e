"""Telemetry tables as views over the given tables.

Each view maps whole given tables to one telemetry table; nothing is materialised, so a report over
a view reads the given parquet and grows with it. The views are written for the cases the reports
must handle (see FIXTURES.md): missing matches, NULL flags and ids, several plans and instances.
"""

from __future__ import annotations

from collections import ChainMap
from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadlens.sources.given import read_given

_VIEWS: dict[str, Callable[["Telemetry"], DataFrame]] = {}


def _view(build: Callable[["Telemetry"], DataFrame]) -> Callable[["Telemetry"], DataFrame]:
    _VIEWS[build.__name__.rstrip("_")] = build
    return build


class Telemetry(Mapping[str, DataFrame]):
    """Lazy telemetry tables over the parquet files in ``sf_dir``."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self._spark = spark
        self._sf_dir = sf_dir

    def given(self, name: str) -> DataFrame:
        return read_given(self._spark, self._sf_dir, name)

    def __getitem__(self, name: str) -> DataFrame:
        return _VIEWS[name](self)

    def __iter__(self) -> Iterator[str]:
        return iter(_VIEWS)

    def __len__(self) -> int:
        return len(_VIEWS)


def _measured(t: Telemetry) -> DataFrame:
    """Events as measurements: an instance, a statement, a plan and an amount in microseconds."""
    return t.given("events").selectExpr(
        "event_id",
        "ts",
        "user_id",
        "event_type",
        "1 as dbid",
        "cast(1 + event_id % 2 as int) as instance_number",
        "timestampdiff(HOUR, timestamp'2023-12-31 00:00:00', ts) as snap_id",
        "concat('s', user_id % 20) as sql_id",
        "cast(case event_type when 'error' then 0 when 'click' then 101 when 'view' then 202 "
        "when 'purchase' then 303 else 404 end as bigint) as plan_hash_value",
        "cast(round(value * 100) as bigint) * 10000 as us",
    )


@_view
def snapshot(t: Telemetry) -> DataFrame:
    hours = t.given("events").select(F.date_trunc("hour", "ts").alias("b")).distinct()
    return hours.selectExpr(
        "1 as dbid",
        "explode(array(1, 2)) as instance_number",
        "timestampdiff(HOUR, timestamp'2023-12-31 00:00:00', b) as snap_id",
        "b as begin_interval_time",
        "b + interval '1' hour as end_interval_time",
        "timestamp'2023-12-31 00:00:00' as startup_time",
    )


@_view
def sqlstat(t: Telemetry) -> DataFrame:
    shares = {
        "elapsed_time_delta": "us",
        "cpu_time_delta": "us % 900000",
        "iowait_delta": "us % 800000",
        "ccwait_delta": "us % 500000",
        "apwait_delta": "us % 400000",
        "plsexec_time_delta": "us % 300000",
        "javexec_time_delta": "us % 200000",
        "disk_reads_delta": "us % 700000",
        "buffer_gets_delta": "us % 600000",
        "rows_processed_delta": "event_id % 11",
        "parse_calls_delta": "event_id % 7",
        "px_servers_execs_delta": "event_id % 5",
    }
    return (
        _measured(t)
        .groupBy("dbid", "instance_number", "snap_id", "sql_id", "plan_hash_value")
        .agg(
            F.min("event_type").alias("module"),
            F.sum(F.expr("case when event_type = 'view' then 0 else 1 end"))
            .cast("bigint")
            .alias("executions_delta"),
            *[F.sum(F.expr(share)).alias(name) for name, share in shares.items()],
        )
    )


@_view
def ash(t: Telemetry) -> DataFrame:
    return _measured(t).selectExpr(
        "dbid",
        "instance_number",
        "snap_id",
        "ts as sample_time",
        "user_id as session_id",
        "(user_id + case when event_id % 4 = 0 then 1 else 0 end) % 3 as session_serial",
        "sql_id",
        "plan_hash_value as sql_plan_hash_value",
        "case when event_type = 'error' then null else event_id % 5 end as sql_exec_id",
        "case when event_type = 'error' then null else date_trunc('day', ts) end as sql_exec_start",
        "us as tm_delta_db_time",
        "us % 900000 as tm_delta_cpu_time",
        "us % 5000000 as delta_read_io_bytes",
        "us % 3000000 as delta_write_io_bytes",
        "case when event_id % 3 = 0 then 'Y' else 'N' end as in_parse",
        "case event_id % 5 when 0 then null when 1 then 'Y' else 'N' end as in_hard_parse",
        "case when event_type = 'click' then 'Y' else 'N' end as in_sql_execution",
        "case when event_id % 7 = 0 then 'Y' else 'N' end as in_plsql_execution",
        "case when event_type = 'signup' then null else 'N' end as in_java_execution",
        "case when event_id % 11 = 0 then 'Y' else 'N' end as in_cursor_close",
    )


@_view
def sysstat(t: Telemetry) -> DataFrame:
    return (
        _measured(t)
        .withColumn(
            "stat_name",
            F.expr(
                "case event_type when 'signup' then 'logons current' "
                "when 'purchase' then 'Session Connect Time' else event_type end"
            ),
        )
        .groupBy("dbid", "instance_number", "snap_id", "stat_name")
        .agg(F.sum("us").alias("value"))
    )


@_view
def sqltext(t: Telemetry) -> DataFrame:
    return t.given("part").selectExpr(
        "concat('s', p_partkey) as sql_id",
        "p_size % 5 as command_type",
        "concat('select * from ', replace(p_name, ' ', '_'), ' where x = 1') as sql_text",
    )


@_view
def command_name(t: Telemetry) -> DataFrame:
    kinds = t.given("part").selectExpr("p_size % 5 as command_type").distinct()
    return kinds.where("command_type <> 4").selectExpr(
        "command_type", "concat('CMD_', command_type) as command_name"
    )


@_view
def job_run(t: Telemetry) -> DataFrame:
    runs = (
        t.given("events")
        .groupBy("user_id", F.date_trunc("day", "ts").alias("day"))
        .agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"))
    )
    return runs.selectExpr(
        "cast(1 + user_id % 1 as int) as dbid",  # no literal: a join on it stays an equi join
        "case when user_id % 7 = 0 then concat('JOB_', user_id) "
        "else concat('TASK$_', user_id % 30, '_', user_id) end as job_name",
        "concat(user_id, ',', user_id % 3) as session_id",
        "first as req_start_date",
        "last - first as run_duration",
        "n * interval '0.001' second as cpu_used",
    )


@_view
def wr_control(t: Telemetry) -> DataFrame:
    """One row a database; the first keeps its history for 30 days, the others for less."""
    return t.given("region").selectExpr(
        "r_regionkey + 1 as dbid",
        "make_dt_interval(0, 1) as snap_interval",
        "make_dt_interval(30 - 10 * least(r_regionkey, 2)) as retention",
    )


@_view
def parallel_task(t: Telemetry) -> DataFrame:
    return t.given("nation").selectExpr(
        "concat('TASK$_', n_nationkey) as job_prefix",
        "n_name as task_name",
        "concat('update ', n_name) as sql_stmt",
    )


@_view
def sql_area(t: Telemetry) -> DataFrame:
    return t.given("orders").selectExpr(
        "concat('s', o_orderkey) as sql_id",
        "1000 + o_orderkey % 9973 as plan_hash_value",
        "0 as child_number",
        "o_custkey % 9 as executions",
        "cast(round(o_totalprice * 100) as bigint) * 100 as elapsed_time",
        "cast(round(o_totalprice * 100) as bigint) * 70 as cpu_time",
        "cast(round(o_totalprice * 100) as bigint) as user_io_wait_time",
        "o_custkey * 3 as disk_reads",
        "o_custkey * 5 as buffer_gets",
        "o_custkey % 100 as rows_processed",
        "concat('select ', o_orderpriority, ' from orders') as sql_fulltext",
    )


@_view
def sqlstats_delta(t: Telemetry) -> DataFrame:
    return t.given("orders").selectExpr(
        "concat(case when o_orderstatus = 'P' then 'x' else 's' end, o_orderkey) as sql_id",
        "1000 + o_orderkey % 9973 as plan_hash_value",
        "o_custkey % 17 as delta_execution_count",
        "cast(round(o_totalprice * 100) as bigint) * 10000 as delta_elapsed_time",
        "cast(round(o_totalprice * 100) as bigint) * 100 as delta_cpu_time",
        "cast(round(o_totalprice * 100) as bigint) as delta_user_io_wait_time",
        "o_custkey * 1000 as delta_concurrency_time",
        "case when o_orderstatus = 'F' then null else o_custkey * 20000 end as avg_hard_parse_time",
        "o_custkey * 3 as delta_disk_reads",
        "o_custkey * 5 as delta_buffer_gets",
        "o_custkey % 100 as delta_rows_processed",
        "o_custkey % 4 as delta_px_servers_executions",
    )


@_view
def plan_line(t: Telemetry) -> DataFrame:
    # Numbered within the plan's own key, so that a join on it needs no exchange of its own, and by all
    # that steps are made of: ties are alike in every read, and every read moves the same columns, so
    # Spark moves them once a query. The steps are made behind the window, so that no text is moved.
    made_of = (
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_extendedprice",
        "l_shipdate",
        "l_quantity",
        "l_returnflag",
        "l_linestatus",
    )
    keys = ("concat('s', l_orderkey) as sql_id", "1000 + l_orderkey % 9973 as plan_hash_value")
    numbered = t.given("lineitem").selectExpr(*keys, *made_of).selectExpr(
        "*",
        f"row_number() over (partition by sql_id, plan_hash_value order by {', '.join(made_of)}) as nr",
    )
    return numbered.selectExpr(
        "sql_id",
        "plan_hash_value",
        "cast(nr - 1 as int) as id",
        "l_linenumber % 4 as depth",
        "concat('OP_', l_returnflag) as operation",
        "case when l_linestatus = 'F' then 'FULL' end as options",
        "case when l_suppkey % 2 = 0 then 'OWN' end as object_owner",
        "case when l_partkey % 3 <> 0 "
        "then concat(case when l_returnflag = 'A' then 'IDX_' else 'PART_' end, l_partkey) end "
        "as object_name",
        "case when l_returnflag = 'A' then 'INDEX (UNIQUE)' else 'TABLE' end as object_type",
        "case when l_linenumber = 1 then 'ALL_ROWS' end as optimizer",
        "cast(l_quantity as bigint) as cost",
        "l_partkey as cardinality",
        "l_suppkey as bytes",
        "cast(l_quantity as bigint) * 900 as cpu_cost",
        "cast(l_quantity as bigint) * 3 as io_cost",
        "case when l_returnflag = 'A' then concat('K=', l_partkey) end as access_predicates",
        "case when l_returnflag = 'R' then concat('V>', l_suppkey) end as filter_predicates",
        "concat('C', l_linenumber) as projection",
    )


@_view
def plan_line_hist(t: Telemetry) -> DataFrame:
    """The steps of older plans of the same statements, over other objects."""
    return plan_line(t).withColumns(
        {
            "plan_hash_value": F.expr("plan_hash_value + 20000"),
            "object_name": F.expr(
                "case when object_type = 'INDEX (UNIQUE)' and object_name is not null "
                "then concat('IDX_', cardinality + 1) else object_name end"
            ),
        }
    )


@_view
def plan_monitor(t: Telemetry) -> DataFrame:
    # Cheap steps but the first go to lines no plan has, so both sides have rows without a partner.
    return plan_line(t).selectExpr(
        "sql_id",
        "plan_hash_value as sql_plan_hash_value",
        "16777216 + plan_hash_value % 3 as sql_exec_id",
        "cast(case when cost > 10 or id = 0 then id else id + 1000 end as int) as plan_line_id",
        "case when cost % 2 = 0 then 'DONE' else 'EXECUTING' end as status",
        "plan_hash_value as sid",
        "timestamp'2024-01-01 00:00:00' as sql_exec_start",
        "timestamp'2024-01-01 00:00:10' as first_refresh_time",
        "timestamp'2024-01-01 00:00:10' + make_dt_interval(0, 0, 0, cost) as last_refresh_time",
        "cost as starts",
        "cardinality as output_rows",
        "cost * 7 as physical_read_requests",
        "bytes * 11 as physical_write_requests",
        "cost * 57344 as physical_read_bytes",
        "bytes * 90112 as physical_write_bytes",
        "case when id > 1 then cost * 1024 end as workarea_max_mem",
        "case when id > 2 then cost * 2048 end as workarea_max_tempseg",
        "depth as plan_depth",
        "operation as plan_operation",
        "options as plan_options",
        "object_owner as plan_object_owner",
        "object_name as plan_object_name",
        "object_type as plan_object_type",
        "cost as plan_cost",
        "cardinality as plan_cardinality",
        "bytes as plan_bytes",
    )


# Some indexes belong to the owner that plan steps name, some to the owner of their table.
_INDEX_OWNER = "case when p_size <= 25 then 'OWN' else p_brand end"


@_view
def idx(t: Telemetry) -> DataFrame:
    return t.given("part").selectExpr(
        f"{_INDEX_OWNER} as owner",
        "concat('IDX_', p_partkey) as index_name",
        "p_brand as table_owner",
        "p_type as table_name",
        "case when p_size % 2 = 0 then 'UNIQUE' else 'NONUNIQUE' end as uniqueness",
        "case when p_size > 40 then 'YES' else 'NO' end as partitioned",
        "p_size * 1000L as num_rows",
        "p_size * 10L as distinct_keys",
        "p_size % 4L as blevel",
        "p_size * 3L as leaf_blocks",
        "10L as pct_free",
    )


@_view
def ind_column(t: Telemetry) -> DataFrame:
    return t.given("part").selectExpr(
        f"{_INDEX_OWNER} as index_owner",
        "concat('IDX_', p_partkey) as index_name",
        "explode(case when p_size % 2 = 0 then array('C1', 'C2', 'C3') else array('C1') end) "
        "as column_name",
    )


@_view
def ind_stat(t: Telemetry) -> DataFrame:
    """One row of each index and one of a partition of it."""
    return idx(t).selectExpr(
        "owner",
        "index_name",
        "explode(array(cast(null as string), 'P1')) as partition_name",
        "num_rows",
    )


@_view
def tbl(t: Telemetry) -> DataFrame:
    return idx(t).select("table_owner", "table_name").distinct().selectExpr(
        "table_owner as owner",
        "table_name",
        "timestamp'2024-01-01 00:00:00' as last_analyzed",
        "'YES' as monitoring",
    )


@_view
def col_stat(t: Telemetry) -> DataFrame:
    return tbl(t).selectExpr("owner", "table_name", "explode(array(1L, 2L)) as k").selectExpr(
        "owner",
        "table_name",
        "concat('C', k) as column_name",
        "k * 4 as avg_col_len",
        "k * 7 as num_nulls",
    )


@_view
def index_segment(t: Telemetry) -> DataFrame:
    return t.given("part").selectExpr(
        f"{_INDEX_OWNER} as owner",
        "concat(case when p_size <= 45 then 'IDX_' else 'LOB_' end, p_partkey) as segment_name",
        "p_size * 65536L as bytes",
    )


@_view
def index_usage(t: Telemetry) -> DataFrame:
    return t.given("part").selectExpr(
        f"{_INDEX_OWNER} as owner",
        "concat(case when p_size > 15 then 'IDX_' else 'GONE_' end, p_partkey) as name",
        "timestamp'2024-01-20 00:00:00' - make_dt_interval(p_size) as last_used",
    )


@_view
def index_usage_info(t: Telemetry) -> DataFrame:
    """One row an instance; the use of indexes is collected by some."""
    return t.given("region").selectExpr(
        "r_regionkey % 2 as index_stats_enabled", "r_regionkey * 10L as active_elem_count"
    )


@_view
def object_usage(t: Telemetry) -> DataFrame:
    return t.given("part").selectExpr(
        "concat(case when p_type <> 'STANDARD' then 'IDX_' else 'GONE_' end, p_partkey) as index_name",
        "p_type as table_name",
        "case when p_size % 3 = 0 then 'NO' else 'YES' end as monitoring",
        "case when p_size % 2 = 0 then 'YES' when p_size % 5 = 0 then 'NO' end as used",
        "'01/31/2024 23:59:58' as start_monitoring",
    )


@_view
def tab_modification(t: Telemetry) -> DataFrame:
    return tbl(t).selectExpr(
        "owner as table_owner",
        "table_name",
        "case when table_name = 'PROMO' then 'P1' end as partition_name",
        "case table_name when 'SMALL' then last_analyzed "
        "when 'LARGE' then timestamp'2023-12-30 00:00:00' "
        "else timestamp'2024-01-03 00:00:00' end as modified_at",
        "1000L as inserts",
        "200L as updates",
        "30L as deletes",
    )


@_view
def constraint_def(t: Telemetry) -> DataFrame:
    return t.given("part").selectExpr(
        f"{_INDEX_OWNER} as index_owner",
        "concat(case when p_brand <> 'Brand#3' then 'IDX_' else 'GONE_' end, p_partkey) as index_name",
        "case when p_size % 2 = 0 then 'P' else 'U' end as constraint_type",
    )


def _with_region(t: Telemetry, name: str, nation_key: str) -> DataFrame:
    rows, nation, region = t.given(name), t.given("nation"), t.given("region")
    return rows.join(nation, rows[nation_key] == nation["n_nationkey"]).join(
        region, nation["n_regionkey"] == region["r_regionkey"]
    )


@_view
def data_file(t: Telemetry) -> DataFrame:
    return _with_region(t, "supplier", "s_nationkey").selectExpr(
        "r_name as tablespace_name", "(s_suppkey + 1) * 1048576 as bytes"
    )


@_view
def temp_file(t: Telemetry) -> DataFrame:
    return t.given("nation").selectExpr(
        "concat('TEMP_', n_regionkey) as tablespace_name", "(n_nationkey + 1) * 1048576L as bytes"
    )


@_view
def segment(t: Telemetry) -> DataFrame:
    return _with_region(t, "customer", "c_nationkey").selectExpr(
        "case when r_name = 'EUROPE' then 'GONE' else r_name end as tablespace_name",
        "n_name as owner",
        "c_name as segment_name",
        "c_custkey % 97 * 8192 as bytes",
    )


@_view
def free_space(t: Telemetry) -> DataFrame:
    return _with_region(t, "supplier", "s_nationkey").selectExpr(
        "case when r_name = 'ASIA' then 'GONE' else r_name end as tablespace_name", "s_suppkey * 24576 as bytes"
    )


@_view
def buffer_header(t: Telemetry) -> DataFrame:
    return t.given("lineitem").selectExpr(
        "l_linenumber * 3 as class_id",
        "l_returnflag as status",
        "l_linestatus as dirty",
        "case when l_quantity > 45 then 'Y' else 'N' end as temp",
        "case when l_linenumber = 1 then null else 'N' end as ping",
        "case when l_quantity < 5 then 'Y' else 'N' end as stale",
        "'N' as direct",
        "'N' as new",
        "l_partkey as objd",
    )


@_view
def object_(t: Telemetry) -> DataFrame:
    return t.given("part").selectExpr("p_partkey as data_object_id", "p_type as object_name")


@_view
def param_def(t: Telemetry) -> DataFrame:
    return t.given("part").selectExpr(
        "p_partkey as indx",
        "concat('_', replace(p_name, ' ', '_'), '_stats') as name",
        "p_type as description",
    )


@_view
def param_session(t: Telemetry) -> DataFrame:
    return t.given("part").selectExpr("p_partkey as indx", "p_brand as value")


@_view
def param_instance(t: Telemetry) -> DataFrame:
    return t.given("part").selectExpr(
        "p_partkey as indx", "concat('Brand#', p_partkey % 25) as value"
    )


@_view
def extent(t: Telemetry) -> DataFrame:
    return t.given("lineitem").selectExpr(
        "l_suppkey as file_id", "l_partkey as block_id", "l_orderkey as extent_id"
    )


@_view
def corruption(t: Telemetry) -> DataFrame:
    return (
        t.given("lineitem")
        .where("l_quantity = 50")
        .selectExpr("l_suppkey as file_id", "l_partkey as block_id")
        .distinct()
    )


@_view
def session(t: Telemetry) -> DataFrame:
    return t.given("customer").selectExpr(
        "c_mktsegment as osuser", "concat('ELEMENT #', c_custkey) as action", "c_custkey as sid"
    )


@_view
def tab_statistic(t: Telemetry) -> DataFrame:
    return t.given("part").selectExpr(
        "concat(case when p_size = 30 then 'ttx$' when p_size = 31 then 'TEMP_' "
        "when p_size = 32 then 'TEMPX' else 'T_' end, p_partkey, "
        "case p_size % 6 when 0 then '_TEST' when 1 then 'XTEST' when 2 then '_tmp1' "
        "when 3 then '_OLD' else '' end) as table_name",
        "case when p_brand = 'Brand#7' then 'ALL' end as stattype_locked",
        "timestamp'2022-09-09 12:34:56' + make_dt_interval(p_size - 45) as last_analyzed",
    )


@_view
def user_tbl(t: Telemetry) -> DataFrame:
    return tab_statistic(t).selectExpr(
        "table_name", "case when table_name like '%7' then 'Y' else 'N' end as temporary"
    )


@_view
def mview_log(t: Telemetry) -> DataFrame:
    return tab_statistic(t).where("table_name like 'T%9'").selectExpr("table_name as log_table")


@_view
def longop(t: Telemetry) -> DataFrame:
    return t.given("events").selectExpr(
        "user_id as sid",
        "user_id % 3 as serial_no",
        "concat('s', user_id % 20) as sql_id",
        "event_type as opname",
        "event_id % 50 as sofar",
        "50L as totalwork",
        "event_id % 90 as elapsed_time",
        "event_id % 7 as time_remaining",
        "concat(event_type, ': ', event_id % 50, ' out of 50') as message",
    )


@_view
def active_now(t: Telemetry) -> DataFrame:
    return t.given("events").selectExpr(
        "user_id as session_id",
        "event_id % 3 as session_serial",
        "concat('s', user_id % 20) as sql_id",
        "concat('s', event_id % 40) as top_level_sql_id",
    )


def two_databases(t: Telemetry) -> Mapping[str, DataFrame]:
    """The tables with a second database beside the first, of the same session and snapshot ids.

    Its snapshots begin half an hour later, it sampled every other sample and ran half of the jobs.
    """
    second = F.lit(2).alias("dbid")

    def moved(df: DataFrame, **changed: str) -> DataFrame:
        return df.select(second, *[F.expr(changed.get(c, c)).alias(c) for c in df.columns if c != "dbid"])

    late = {f"{c}_interval_time": f"{c}_interval_time + interval '30' minute" for c in ("begin", "end")}
    added = {
        "snapshot": moved(t["snapshot"], **late),
        "ash": moved(t["ash"].where("in_parse = 'N'"), tm_delta_db_time="tm_delta_db_time * 2"),
        "job_run": moved(t["job_run"].where("session_id like '%,1'")),
    }
    return ChainMap({name: t[name].unionByName(df) for name, df in added.items()}, t)
