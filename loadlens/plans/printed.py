"""Execution plans printed as indented text, one row per line.

The header lines of a plan hang on its first step (id 0). They are made by exploding a literal list
of line kinds in place, so no join or second read of the plan rows is needed. Lines are printed
before they are sorted, so the sort moves finished text only. What a header is made of crosses the
joins as numbers and is printed behind them, on first steps alone.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadlens.functions import grouped_text, half_up, indent, number_text, text_cat
from loadlens.operators.common import Tables, only

_MICRO = 1_000_000


def _when_set(value: Column, text: Column) -> Column:
    return F.when(value.isNotNull(), text)


def _step_text(prefix: str = "", *, optimizer: bool) -> Column:
    """One plan step: indentation, operation, options, object and estimates."""

    def c(name: str) -> Column:
        return F.col(prefix + name)

    owner = _when_set(c("object_owner"), text_cat(c("object_owner"), "."))
    return text_cat(
        indent(c("depth"), 4),
        c("operation"),
        _when_set(c("optimizer"), text_cat("  Optimizer=", c("optimizer"))) if optimizer else "",
        _when_set(c("options"), text_cat(" (", c("options"), ")")),
        _when_set(c("object_name"), text_cat(" OF '", owner, c("object_name"), "'")),
        F.when(c("object_type") == "INDEX (UNIQUE)", F.lit(" (UNIQUE)")),
        text_cat("  (Cost=", c("cost"), " Card=", c("cardinality"), " Bytes=", c("bytes"), ")"),
    )


def _explode_lines(df: DataFrame, kinds: list[int], step: str) -> DataFrame:
    """Repeat each step once per line kind not below its id; later steps stay single.

    ``line_pos`` is the position among the lines of one step, ``line_kind`` is 0 for headers.
    """
    lines = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(k).alias("kind")) for i, k in enumerate(kinds)])
    kept = F.filter(lines, lambda line: line["kind"] >= F.col(step))
    return (
        df.withColumn("line", F.explode_outer(kept))
        .withColumn("line_pos", F.col("line.pos"))
        .withColumn("line_kind", F.col("line.kind"))
        .drop("line")
    )


def _is_header() -> Column:
    return F.coalesce(F.col("line_kind") == 0, F.lit(False))


def _step_id(step: str) -> Column:
    return F.when(~_is_header(), F.col(step)).alias("id")


_TOTALS = [
    "delta_execution_count",
    "delta_elapsed_time",
    "delta_cpu_time",
    "delta_user_io_wait_time",
    "delta_concurrency_time",
    "avg_hard_parse_time",
    "delta_disk_reads",
    "delta_buffer_gets",
    "delta_rows_processed",
    "delta_px_servers_executions",
]


def plan_monitor_report(
    tables: Tables,
    *,
    sql_id: str | None = None,
    plan_hash_value: int | None = None,
    sql_exec_id: int | None = None,
) -> DataFrame:
    """Printed plans of monitored executions with their actuals.

    Two headers, then one line per step. The second header is NULL when the statement has no
    statistics row. Without arguments every execution is printed; the key columns tell them apart.
    """
    steps = tables["plan_monitor"]
    for column, value in (
        ("sql_id", sql_id),
        ("sql_plan_hash_value", plan_hash_value),
        ("sql_exec_id", sql_exec_id),
    ):
        steps = steps if value is None else steps.where(F.col(column) == value)

    def of(counter: str) -> Column:
        return F.col(f"totals.{counter}")

    def seconds(counter: str) -> Column:
        return grouped_text(half_up(of(counter), scale=_MICRO // 100))

    totals = text_cat(
        "SQLSTAT: , e = ",
        of("delta_execution_count"),
        ", ela = ",
        seconds("delta_elapsed_time"),
        ", cpu = ",
        seconds("delta_cpu_time"),
        ", io = ",
        seconds("delta_user_io_wait_time"),
        ", cc = ",
        seconds("delta_concurrency_time"),
        ", parse = ",
        seconds("avg_hard_parse_time"),
        ", disk = ",
        of("delta_disk_reads"),
        ", lio = ",
        of("delta_buffer_gets"),
        ", r = ",
        of("delta_rows_processed"),
        ", px = ",
        of("delta_px_servers_executions"),
    )
    stats = tables["sqlstats_delta"].select(
        "sql_id", F.col("plan_hash_value").alias("sql_plan_hash_value"), F.struct(*_TOTALS).alias("totals")
    )
    title = text_cat(
        "SQL_ID = ",
        F.col("sql_id"),
        ", phv = ",
        F.col("sql_plan_hash_value"),
        ", eid = ",
        F.col("sql_exec_id"),
    )
    key = ["sql_id", "sql_plan_hash_value"]
    lines = _explode_lines(steps.join(stats, key, "left"), [0, 0, 1], "plan_line_id")
    return (
        lines.select(
            *key,
            "sql_exec_id",
            F.col("plan_line_id").alias("step"),
            "line_pos",
            _step_id("plan_line_id"),
            F.when(_is_header() & (F.col("line_pos") == 0), title)
            .when(_is_header(), F.when(F.col("totals").isNotNull(), totals))
            .otherwise(_step_text("plan_", optimizer=False))
            .alias("sqlplan"),
            "starts",
            F.col("output_rows").alias("a_rows"),
            (F.col("last_refresh_time") - F.col("first_refresh_time")).alias("a_time"),
            (F.col("physical_read_requests") + F.col("physical_write_requests")).alias("rwreq"),
            (F.col("physical_read_bytes") + F.col("physical_write_bytes")).alias("rwbyt"),
            F.col("workarea_max_mem").alias("max_mem"),
            F.col("workarea_max_tempseg").alias("max_temp"),
        )
        .orderBy(*key, "sql_exec_id", "step", "line_pos")
        .drop("step", "line_pos")
    )


_COUNTERS = [
    "executions",
    "elapsed_time",
    "cpu_time",
    "user_io_wait_time",
    "disk_reads",
    "buffer_gets",
    "rows_processed",
]


def _cursor_header(*, child: bool) -> Column:
    """The header of a cursor, printed from its key and ``counters``."""

    def of(counter: str) -> Column:
        return F.col(f"counters.{counter}")

    def seconds(counter: str) -> Column:
        return number_text(half_up(of(counter), scale=_MICRO // 100))

    own = [", cn = ", F.col("child_number"), ", e = ", of("executions")] if child else []
    return text_cat(
        "SQL_ID = ",
        F.col("sql_id"),
        ", hv = ",
        F.col("plan_hash_value"),
        *own,
        ", ela = ",
        seconds("elapsed_time"),
        ", cpu = ",
        seconds("cpu_time"),
        ", io = ",
        seconds("user_io_wait_time"),
        ", disk = ",
        of("disk_reads"),
        ", lio = ",
        of("buffer_gets"),
        ", r = ",
        of("rows_processed"),
    )


_PLAN_KEY = ["sql_id", "plan_hash_value"]


def _cursors(tables: Tables, sql_ids: Iterable[str] | None) -> DataFrame:
    cursors = only(tables["sql_area"], "sql_id", sql_ids)
    return cursors.select(*_PLAN_KEY, "child_number", F.struct(*_COUNTERS).alias("counters"))


def plan_tree(
    tables: Tables, *, sql_ids: Iterable[str] | None = None, child_number: int = 0
) -> DataFrame:
    """Printed plans of cursors: one header with the cursor's totals, then one line per step."""
    cursors = _cursors(tables, sql_ids).where(F.col("child_number") == child_number)
    steps = cursors.join(only(tables["plan_line"], "sql_id", sql_ids), _PLAN_KEY)
    return (
        _explode_lines(steps, [0, 1], "id")
        .select(
            *_PLAN_KEY,
            F.col("id").alias("step"),
            "line_pos",
            _step_id("id"),
            F.when(_is_header(), _cursor_header(child=True)).otherwise(_step_text(optimizer=True)).alias("sqlplan"),
            "access_predicates",
            "filter_predicates",
        )
        .orderBy(*_PLAN_KEY, "step", "line_pos")
        .drop("step", "line_pos")
    )


def plan_tree_with_actuals(
    tables: Tables, *, sql_ids: Iterable[str] | None = None, exec_id: int | None = None
) -> DataFrame:
    """Printed plans with what each step did in the given execution (in each, without one).

    Steps never monitored join the actuals as rows without figures, found from keys alone, so that
    the wide join runs once and is an inner one: Spark can split a hot step of an inner join on
    either side, but not the inner side of an outer join. Steps and actuals meet under the plan's
    own key and the step, so tables that lie by plan can meet where they lie (see README). The
    steps are the side a join holds in memory; idle steps come first, before actuals are sorted.
    """
    monitor = only(tables["plan_monitor"], "sql_id", sql_ids)
    if exec_id is not None:
        monitor = monitor.where(F.col("sql_exec_id") == exec_id)
    actuals = monitor.select(
        "sql_id",
        F.col("sql_plan_hash_value").alias("plan_hash_value"),
        F.col("plan_line_id").alias("id"),
        "sql_exec_id",
        "starts",
        "output_rows",
        (F.col("physical_read_requests") + F.col("physical_write_requests")).alias("rwreq"),
        (F.col("physical_read_bytes") + F.col("physical_write_bytes")).alias("rwbyt"),
        F.col("workarea_max_mem").alias("max_mem"),
        F.col("workarea_max_tempseg").alias("max_temp"),
    )
    step = [*_PLAN_KEY, "id"]
    lines = only(tables["plan_line"], "sql_id", sql_ids)
    # A step without an id meets no actuals and stays.
    actuals = actuals.where("id is not null")
    idle = lines.select(*step).join(actuals.select(*step).distinct(), step, "left_anti").distinct()
    found = idle.unionByName(actuals, allowMissingColumns=True)
    found = found.withColumnsRenamed({name: f"_{name}" for name in step})
    steps = _cursors(tables, sql_ids).join(lines, _PLAN_KEY)
    steps = steps.select(
        *step,
        _step_text(optimizer=True).alias("text"),
        F.when(F.col("id") <= 0, _cursor_header(child=False)).alias("header"),
        "access_predicates",
        "filter_predicates",
        "projection",
    )
    same_step = [F.col(name) == F.col(f"_{name}") for name in _PLAN_KEY]
    same_step.append(F.col("id").eqNullSafe(F.col("_id")))
    rows = found.join(steps, same_step).drop(*[f"_{name}" for name in step])
    return (
        _explode_lines(rows, [0, 1], "id")
        .select(
            *_PLAN_KEY,
            "sql_exec_id",
            F.col("id").alias("step"),
            "line_pos",
            _step_id("id"),
            F.when(_is_header(), F.col("header")).otherwise(F.col("text")).alias("sqlplan"),
            "starts",
            "output_rows",
            "rwreq",
            "rwbyt",
            "max_mem",
            "max_temp",
            "access_predicates",
            "filter_predicates",
            "projection",
        )
        .orderBy(*_PLAN_KEY, "step", "line_pos", "sql_exec_id")
        .drop("step", "line_pos")
    )


def plan_lines(
    tables: Tables, *, sql_ids: Iterable[str] | None = None, source: str = "plan_line"
) -> DataFrame:
    """Plain plan rows with the operation indented by depth. ``source`` names the plan table."""
    return (
        only(tables[source], "sql_id", sql_ids)
        .select(
            "sql_id",
            "plan_hash_value",
            "id",
            F.concat(indent(F.col("depth")), F.col("operation")).alias("operation"),
            "options",
            "object_owner",
            "object_name",
            "object_type",
            "optimizer",
            "cost",
            "cardinality",
            "bytes",
            "cpu_cost",
            "io_cost",
            "access_predicates",
            "filter_predicates",
        )
        .orderBy("plan_hash_value", "id", "sql_id")
    )
