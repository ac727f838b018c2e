"""Telemetry tables kept as parquet, one folder per table."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import date, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loadlens.sources.schemas import BY_DATABASE, FACTS, OPEN, SCHEMAS

SNAP_KEYS = ["dbid", "instance_number", "snap_id"]


def read_telemetry(
    spark: SparkSession,
    root: str,
    names: Iterable[str] | None = None,
    *,
    open_tables: Iterable[str] = OPEN,
) -> dict[str, DataFrame]:
    """Lazy readers of the named tables (all by default), each with its explicit schema.

    Tables in ``open_tables`` also have the columns their files hold beyond the schema.
    """
    open_tables, tables = set(open_tables), {}
    for name in SCHEMAS if names is None else names:
        path = f"{root}/{name}"
        if name in open_tables:
            tables[name] = read_open(spark, path, SCHEMAS[name])
        else:
            day = ", snap_day date" if name in FACTS else ""
            tables[name] = spark.read.schema(SCHEMAS[name] + day).parquet(path)
    return tables


def read_open(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table with its declared columns first, of the declared types, then all others of any file.

    The others are merged over the footers of all files, by a Spark job. A file without one of them
    gives NULL, as one without a declared column does. Files that disagree on the type of a column
    that is not declared raise.
    """
    core = StructType.fromDDL(schema)
    try:
        found = spark.read.option("mergeSchema", "true").parquet(path).schema
    except AnalysisException as error:
        if error.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        found = StructType()  # no file yet
    declared = {f.name.lower() for f in core}
    further = [f for f in found if f.name.lower() not in declared]
    return spark.read.schema(StructType([*core, *further])).parquet(path)


def with_snap_day(fact: DataFrame, snapshot: DataFrame) -> DataFrame:
    """The fact with the day its snapshot began; NULL where the snapshot is unknown."""
    days = snapshot.select(*SNAP_KEYS, F.to_date("begin_interval_time").alias("snap_day"))
    return fact.join(days, SNAP_KEYS, "left")


def write_telemetry(tables: Mapping[str, DataFrame], root: str, mode: str = "errorifexists") -> None:
    """Store tables under ``root``; facts are partitioned by ``snap_day``, logs by their database.

    The rebalance hint gives each day as many even files as it needs, so a day that holds a large
    share of the rows is split over tasks and small days make few files.
    """
    for name, df in tables.items():
        if name in FACTS:
            if "snap_day" not in df.columns:
                df = with_snap_day(df, tables["snapshot"])
            df = df.hint("rebalance", "snap_day")
            df.write.mode(mode).partitionBy("snap_day").parquet(f"{root}/{name}")
        elif name in BY_DATABASE and "dbid" in df.columns:
            df.hint("rebalance", "dbid").write.mode(mode).partitionBy("dbid").parquet(f"{root}/{name}")
        else:
            df.write.mode(mode).parquet(f"{root}/{name}")


def prune_days(
    fact: DataFrame, first: date | None, last: date | None, *, keep_unknown: bool = False
) -> DataFrame:
    """Skip the stored days outside ``first`` to ``last`` (dates or times; None leaves a side open).

    This is a filter on the partition column, for callers whose later join implies it. Rows whose
    snapshot was unknown when they were stored stay only with ``keep_unknown``. Tables stored
    without ``snap_day`` are returned as they are.
    """
    if "snap_day" not in fact.columns:
        return fact
    day, inside = F.col("snap_day"), F.lit(True)
    if first is not None:
        inside = inside & (day >= _day_lit(first))
    if last is not None:
        inside = inside & (day <= _day_lit(last))
    if keep_unknown:
        inside = inside | day.isNull()
    return fact.where(inside).drop("snap_day")


def _day_lit(at: date) -> Column:
    return F.lit(_plain_day(at))


def write_report(
    report: DataFrame, root: str, name: str, *, day: date | None = None, by: str | None = None
) -> None:
    """Store a report under ``root/name`` by ``report_day``; a rerun replaces its days only.

    ``day`` is the day the whole report is of: its folder is replaced, by an empty one if the report
    has no rows. ``by`` names a date or time column that gives each row its day: the days that occur
    are replaced, all others stay.
    """
    if (day is None) == (by is None):
        raise ValueError("a report is of one day or has a column with days")
    path = f"{root}/{name}"
    if day is not None:
        report.write.mode("overwrite").parquet(f"{path}/report_day={_plain_day(day)}")
        return
    dated = report.withColumn("report_day", F.to_date(by)).hint("rebalance", "report_day")
    writer = dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("report_day").parquet(path)


def read_report(spark: SparkSession, root: str, name: str, schema: StructType | str) -> DataFrame:
    """A stored report of the given schema, with ``report_day``; a filter on it reads its folders only."""
    core = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return spark.read.schema(StructType([*core]).add("report_day", "date")).parquet(f"{root}/{name}")


def _plain_day(at: date) -> date:
    return at.date() if isinstance(at, datetime) else at
