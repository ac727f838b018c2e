"""Reports on parallel job groups: what ran, for how long, and which statements it ran."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadlens.functions import half_up, like, range_text, ts_lit, whole_second
from loadlens.operators.common import (
    Tables,
    broadcast_if_small,
    measured,
    settled,
    shared,
    with_days,
)

# The shape of a job name of a parallel task, and the group part of it.
JOB_NAME = r"^TASK\$_\d+_\d+$"
JOB_PREFIX = r"^TASK\$_\d+"

# What a row of the attribution stands for before the last reduction.
_GROUP, _JOB, _ALL = "group", "job", "all"

_JOB_KEY = ["job_prefix", "sid", "serial", "start_snap", "stop_snap"]


def _job_runs(
    tables: Tables,
    as_of: datetime | None = None,
    retention: timedelta | None = None,
    job_like: str | None = None,
) -> DataFrame:
    runs = tables["job_run"].where(F.col("job_name").rlike(JOB_NAME))
    if retention is not None:
        oldest = as_of - retention - timedelta(days=1)
        runs = runs.where(F.col("req_start_date") >= ts_lit(oldest))
    elif as_of is not None:
        runs = _kept_runs(runs, tables["wr_control"], as_of)
    if job_like is not None:
        runs = runs.where(like(F.col("job_name"), job_like))
    return runs.withColumn("job_prefix", F.regexp_substr("job_name", F.lit(JOB_PREFIX)))


def _kept_runs(runs: DataFrame, control: DataFrame, as_of: datetime) -> DataFrame:
    """Runs that began within the time their database keeps its history, and a day before it.

    The earliest bound of all databases is a scalar subquery, which the scan of the log gets as a
    filter at run time. A database without a control row keeps nothing.
    """
    oldest = (ts_lit(as_of) - F.col("retention") - F.expr("interval '1' day")).alias("oldest")
    earliest = control.agg(F.min(oldest)).scalar()
    runs = runs.where(F.col("req_start_date") >= earliest)
    if "dbid" not in runs.columns:
        return runs
    bounds = broadcast_if_small(control.groupBy("dbid").agg(F.min(oldest).alias("oldest")))
    return runs.join(bounds, "dbid").where("req_start_date >= oldest").select(*runs.columns)


def job_group_summary(
    tables: Tables, *, as_of: datetime, retention: timedelta | None = None
) -> DataFrame:
    """Job groups kept in the log: jobs, first start, spread of duration and cpu, and their task.

    Without ``retention`` each database's own from ``wr_control`` counts. A log of several databases
    has a row a database and group.
    """
    runs = _job_runs(tables, as_of, retention)
    by = shared(["dbid"], runs)
    groups = (
        runs.groupBy(*by, "job_prefix")
        .agg(
            F.countDistinct("job_name").alias("job_count"),
            whole_second(F.min("req_start_date")).alias("job_start_date"),
            F.min("run_duration").alias("min_duration"),
            F.max("run_duration").alias("max_duration"),
            F.min("cpu_used").alias("min_cpu_used"),
            F.max("cpu_used").alias("max_cpu_used"),
        )
    )
    tasks = tables["parallel_task"].select("job_prefix", "task_name", "sql_stmt")
    return (
        groups.join(tasks, "job_prefix", "left")
        .select(*groups.columns, "task_name", "sql_stmt")
        .orderBy(F.col("max_duration").desc_nulls_first(), "job_prefix", *by)
    )


def add_snaps(
    runs: DataFrame, snapshots: DataFrame, by: list[str], *, start: str, stop: str
) -> DataFrame:
    """Runs with ``start_snap`` and ``stop_snap``, the snapshots their two times fall into.

    ``runs`` has distinct rows. Each snapshot is listed under every hour it touches, so the lookup
    is an equi join on the hour with the exact borders as a residual. A time on a border lies in two
    snapshots; the lower id is taken. A time outside every snapshot has none. Instances that share
    an interval are folded first.
    """
    hour = F.expr("interval 1 hour")
    first, last = (F.date_trunc("hour", f"{s}_interval_time") for s in ("begin", "end"))
    cells = (
        snapshots.groupBy(*by, "begin_interval_time", "end_interval_time")
        .agg(F.min("snap_id").alias("snap_id"))
        .withColumn("cell", F.explode(F.sequence(first, last, hour)))
    )
    ends = F.array(
        *[F.struct(F.lit(k).alias("end"), F.col(c).alias("at")) for k, c in enumerate((start, stop))]
    )
    points = runs.withColumn("point", F.explode(ends)).withColumn(
        "cell", F.date_trunc("hour", "point.at")
    )
    p, c = points.alias("p"), broadcast_if_small(cells).alias("c")
    same_cell = [F.col(f"p.{k}") == F.col(f"c.{k}") for k in [*by, "cell"]]
    inside = F.col("p.point.at").between(
        F.col("c.begin_interval_time"), F.col("c.end_interval_time")
    )
    found = p.join(c, [*same_cell, inside], "left").select(
        *[F.col(f"p.{name}").alias(name) for name in runs.columns],
        F.col("p.point.end").alias("end"),
        F.col("c.snap_id").alias("snap_id"),
    )
    return found.groupBy(*runs.columns).agg(
        F.min(F.when(F.col("end") == 0, F.col("snap_id"))).alias("start_snap"),
        F.min(F.when(F.col("end") == 1, F.col("snap_id"))).alias("stop_snap"),
    )


def _jobs(tables: Tables, runs: DataFrame, by: list[str]) -> DataFrame:
    """Runs alike in group, session and snapshots, folded into one row that counts them."""
    distinct_runs = (
        runs.withColumn("stop_at", F.col("req_start_date") + F.col("run_duration"))
        .groupBy(*by, "job_prefix", "session_id", "req_start_date", "run_duration", "stop_at")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    part = F.split("session_id", ",")
    return (
        add_snaps(distinct_runs, tables["snapshot"], by, start="req_start_date", stop="stop_at")
        .withColumn("sid", F.try_element_at(part, F.lit(1)).try_cast("bigint"))
        .withColumn("serial", F.try_element_at(part, F.lit(2)).try_cast("bigint"))
        .groupBy(*by, *_JOB_KEY)
        .agg(
            F.sum("n").alias("n"),
            F.min("req_start_date").alias("min_start"),
            F.max("run_duration").alias("max_duration"),
        )
    )


def aligned_blocks(start: str, stop: str) -> Column:
    """The whole numbers from ``start`` to ``stop`` as aligned blocks: an array of ``level`` and ``block``.

    A block of level k holds the 2**k numbers whose quotient by 2**k it is. At most two blocks a
    level are needed, so a span of n numbers gives at most 2 * log2(n) + 2; an empty span gives none.
    """
    length = F.greatest(F.col(stop) - F.col(start) + 1, F.lit(1))
    levels = F.sequence(F.lit(0), F.floor(F.log2(length)).cast("int") + 1)

    def at(level: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("bigint"), level)
        # The blocks of this level that lie inside, first and last.
        first = F.call_function("shiftright", F.col(start) + size - 1, level)
        last = F.call_function("shiftright", F.col(stop) + 1, level) - 1
        # An end block stays if its pair, the block of the next level, reaches outside.
        ends = F.array(F.when(F.abs(first % 2) == 1, first), F.when(F.abs(last % 2) == 0, last))
        inside = F.filter(ends, lambda b: b.isNotNull() & (first <= last))
        return F.transform(inside, lambda b: F.struct(level.alias("level"), b.alias("block")))

    return F.flatten(F.transform(levels, at))


def _attribution(tables: Tables, runs: DataFrame, by: list[str]) -> DataFrame:
    """Samples of the sessions of each job between its first and last snapshot.

    One row per job group and statement (``level`` "group") and one over everything ("all"), with
    left-join meaning: a job without any sample counts once, under no statement.

    The snapshots a job spans are cut into aligned blocks, a few for any span, and a sample lies in
    one block of each level that occurs. So samples meet jobs by equality on session and block, and
    only the days and snapshots spanned are read. While the blocks are proven few they are broadcast
    and the samples are filtered in place; beyond that the samples are reduced per session, snapshot
    and execution before they are shuffled. Either way the matches are reduced
    per job, statement and execution before the levels are formed. The samples are read once: the
    same pass also counts samples per job, which tells the jobs that had none.
    """
    job = [*by, *_JOB_KEY]
    jobs = settled(_jobs(tables, runs, by))
    session = [*by, "session_id", "session_serial", "snap_id"]
    spans = (
        jobs.where("start_snap <= stop_snap")
        .select("*", F.inline(aligned_blocks("start_snap", "stop_snap")))
        .withColumns({"session_id": F.col("sid"), "session_serial": F.col("serial")})
    )
    levels = [row["level"] for row in spans.select("level").distinct().collect()]  # 64 at most
    run = F.when(
        F.col("sql_exec_id").isNotNull() | F.col("sql_exec_start").isNotNull(),
        F.struct("sql_exec_id", whole_second(F.col("sql_exec_start"))),
    )
    window = measured(spans, low="start_snap", high="stop_snap")
    ash = tables["ash"]
    if "snap_day" in ash.columns:
        window = with_days(window, tables["snapshot"])
    samples = window.keep(ash, keep_unknown=True).select(
        *session,
        "sql_id",
        run.alias("run"),
        F.lit(1).cast("bigint").alias("sampled"),
        F.col("tm_delta_db_time").alias("db"),
        F.col("tm_delta_cpu_time").alias("cpu"),
    )
    if not window.few:
        samples = samples.groupBy(*session, "sql_id", "run").agg(
            *[F.sum(c).alias(c) for c in ("sampled", "db", "cpu")]
        )
    blocks = [
        F.struct(F.lit(k).alias("level"), F.shiftright("snap_id", k).alias("block")) for k in sorted(levels)
    ]
    samples = samples.select("*", F.inline(F.array(*blocks))) if blocks else samples.select(
        "*", F.lit(0).alias("level"), F.col("snap_id").alias("block")
    )
    n = F.col("n")
    # One row per job, statement and execution, before the grouping sets triple the rows.
    met = (
        samples.drop("snap_id")
        .join(window.rows, [*by, "session_id", "session_serial", "level", "block"])
        .groupBy(*job, "sql_id", "run")
        .agg(
            F.sum(F.col("sampled") * n).alias("rowcount"),
            F.sum(F.col("db") * n).alias("db"),
            F.sum(F.col("cpu") * n).alias("cpu"),
            F.min("min_start").alias("min_start"),
            F.max("max_duration").alias("max_duration"),
        )
    )
    hits = (
        met.groupingSets([[*by, "job_prefix", "sql_id"], job, []], *job, "sql_id")
        .agg(
            F.when(F.grouping("sid") == 0, _JOB)
            .when(F.grouping("job_prefix") == 0, _GROUP)
            .otherwise(_ALL)
            .alias("level"),
            F.sum("rowcount").alias("rowcount"),
            F.countDistinct("run").alias("unq_run"),
            F.sum("db").alias("db"),
            F.sum("cpu").alias("cpu"),
            *_bounds("start_snap", "stop_snap", "min_start", "max_duration"),
        )
    )
    return _add_idle_jobs(hits, jobs, job, by)


def _bounds(start_snap: str, stop_snap: str, min_start: str, max_duration: str) -> list[Column]:
    return [
        F.min(start_snap).alias("low_snap"),
        F.max(stop_snap).alias("high_snap"),
        F.min(min_start).alias("first_start"),
        F.max(max_duration).alias("longest"),
    ]


def _add_idle_jobs(hits: DataFrame, jobs: DataFrame, job: list[str], by: list[str]) -> DataFrame:
    """Add the jobs that met no sample to "no statement" of their group and to the overall row.

    The per-job rows of ``hits`` and the jobs themselves are brought together by grouping, not by
    a join, so ``hits`` is computed once.
    """
    none = F.lit(None)
    listed = jobs.select(
        *job,
        none.cast("string").alias("sql_id"),
        F.lit(_JOB).alias("level"),
        F.lit(0).cast("bigint").alias("rowcount"),
        F.lit(0).cast("bigint").alias("unq_run"),
        none.cast("bigint").alias("db"),
        none.cast("bigint").alias("cpu"),
        F.col("start_snap").alias("low_snap"),
        F.col("stop_snap").alias("high_snap"),
        F.col("min_start").alias("first_start"),
        F.col("max_duration").alias("longest"),
        F.col("n"),
    )
    merged = [
        *_bounds("low_snap", "high_snap", "first_start", "longest"),
        F.sum("rowcount").alias("rowcount"),
        F.sum("unq_run").alias("unq_run"),
        F.sum("db").alias("db"),
        F.sum("cpu").alias("cpu"),
    ]
    per_level = (
        hits.withColumn("n", F.lit(0).cast("bigint"))
        .unionByName(listed)
        .groupBy("level", "sql_id", *job)
        .agg(*merged, F.sum("n").alias("n"))
    )
    is_job = F.col("level") == _JOB
    idle = is_job & (F.col("rowcount") == 0)
    targets = F.when(is_job, F.array(F.lit(_GROUP), F.lit(_ALL))).otherwise(F.array("level"))
    return (
        per_level.where(~is_job | idle)
        .withColumn("rowcount", F.when(is_job, F.col("n")).otherwise(F.col("rowcount")))
        .withColumn("level", F.explode(targets))
        .withColumns({c: F.when(F.col("level") == _GROUP, F.col(c)) for c in [*by, "job_prefix"]})
        .groupBy("level", *by, "job_prefix", "sql_id")
        .agg(*merged)
    )


def _figures() -> list[Column]:
    return [
        range_text(F.col("low_snap"), F.col("high_snap")).alias("range_snap"),
        F.col("unq_run"),
        F.col("rowcount"),
        half_up(F.col("db"), scale=1_000_000).alias("db_time"),
        half_up(F.col("cpu"), scale=1_000_000).alias("cpu_time"),
    ]


def job_sql_attribution(tables: Tables, *, job_like: str) -> DataFrame:
    """Statements run by the jobs whose name is like the pattern, and a row over all of them.

    A log of several databases has a row a database, group and statement.
    """
    by = shared(["dbid"], tables["job_run"], tables["ash"], tables["snapshot"])
    rows = _attribution(tables, _job_runs(tables, job_like=job_like), by)
    return rows.select(*by, "job_prefix", "sql_id", *_figures()).orderBy(
        F.col("job_prefix").asc_nulls_last(), F.col("rowcount").desc_nulls_first(), "sql_id", *by
    )


def job_sql_attribution_all(
    tables: Tables, *, as_of: datetime, retention: timedelta | None = None
) -> DataFrame:
    """Statements run by every job group kept in the log, for groups with sampled database time.

    Without ``retention`` each database's own from ``wr_control`` counts.
    """
    by = shared(["dbid"], tables["job_run"], tables["ash"], tables["snapshot"])
    runs = _job_runs(tables, as_of, retention)
    sessions = runs.groupBy(*by, "job_prefix").agg(F.countDistinct("session_id").alias("job_count"))
    rows = (
        _attribution(tables, runs, by)
        .where((F.col("level") == _GROUP) & F.col("db").isNotNull())
        .join(sessions, [*by, "job_prefix"])
    )
    return rows.select(
        *by,
        "job_prefix",
        "job_count",
        F.col("first_start").alias("min_start_date"),
        F.col("longest").alias("max_duration"),
        "sql_id",
        *_figures(),
    ).orderBy(F.col("db_time").desc_nulls_first(), "job_prefix", "sql_id", *by)
