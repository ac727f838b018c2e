"""Reports for statistics upkeep: what is locked, what is due, what to leave out."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadlens.functions import like, ts_lit
from loadlens.operators.common import Tables

# Upper-cased names of tables to leave out unless told otherwise, as LIKE patterns.
SKIPPED_NAMES = (
    "TTX$%",
    "TDS$%",
    "TUP$%",
    r"%\_TEST%",
    r"%\_TEMP%",
    r"TEMP\_%",
    r"%\_TMP%",
    r"TMP\_%",
    r"%\_OLD%",
)


def locked_stats(tables: Tables) -> DataFrame:
    """Tables whose statistics are locked."""
    return tables["tab_statistic"].where("stattype_locked is not null")


def pending_stats(tables: Tables, *, since: datetime) -> DataFrame:
    """Unlocked tables last analysed at or before a time."""
    due = F.col("last_analyzed") <= ts_lit(since)
    return tables["tab_statistic"].where(F.col("stattype_locked").isNull() & due)


def stats_exclusions(
    tables: Tables, *, since: datetime, skipped_names: Iterable[str] = SKIPPED_NAMES
) -> DataFrame:
    """Unlocked tables to leave out of a gathering run that started at ``since``.

    Left out are tables analysed since then, temporary tables, logs of materialised views and tables
    with one of ``skipped_names`` (LIKE patterns of upper-cased names, escaped by a backslash).
    """
    logs = tables["mview_log"].select(F.col("log_table").alias("table_name")).distinct()
    unlocked = tables["tab_statistic"].where("stattype_locked is null")
    name = F.upper("table_name")
    skipped = reduce(lambda a, b: a | b, (like(name, p, "\\") for p in skipped_names), F.lit(False))
    return (
        tables["user_tbl"]
        .join(unlocked, "table_name")
        .join(logs.withColumn("is_log", F.lit(True)), "table_name", "left")
        .where(
            (F.col("last_analyzed") >= ts_lit(since))
            | (F.col("temporary") == "Y")
            | F.col("is_log").isNotNull()
            | skipped
        )
        .select("table_name")
    )


def gather_exclusions(
    tables: Tables, *, since: datetime, skipped_names: Iterable[str] = SKIPPED_NAMES
) -> DataFrame:
    """Names a gathering run leaves out: locked tables and ``stats_exclusions``, each once.

    This is what ``table_profile`` takes as ``exclude``.
    """
    locked = locked_stats(tables).select("table_name")
    return locked.unionByName(
        stats_exclusions(tables, since=since, skipped_names=skipped_names)
    ).distinct()
