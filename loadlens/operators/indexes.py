"""Reports on indexes: size against an estimate, and use."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadlens.functions import half_up, ts_lit
from loadlens.functions.rounding import WIDE
from loadlens.operators.common import Tables, only
from loadlens.operators.storage import MIB

# Fixed value: bytes of a row id and the row header in each index entry.
ENTRY_BYTES = 12


def index_size_estimate(
    tables: Tables, *, owner: str | None = None, indexes: Iterable[str] | None = None
) -> DataFrame:
    """Allocated size of each index against the size its columns' statistics imply.

    The column statistics are summed per index first and left joined, so an index whose columns
    have none stays with empty figures.
    """
    idx = only(tables["idx"], "index_name", indexes)
    idx = idx if owner is None else idx.where(F.col("owner") == owner)
    entries = tables["ind_stat"].where("partition_name is null")  # the row of the whole index
    columns = tables["ind_column"].select(
        F.col("index_owner").alias("owner"), "index_name", "column_name"
    )
    rowset = (F.col("entries") - F.col("num_nulls")) * F.col("avg_col_len")
    key = ["owner", "index_name"]
    rows = (
        idx.select(*key, "table_owner", "table_name")
        .join(columns, key)
        .join(entries.select(*key, F.col("num_rows").alias("entries")), key)
        .join(
            tables["col_stat"].select(
                F.col("owner").alias("table_owner"),
                "table_name",
                "column_name",
                "avg_col_len",
                "num_nulls",
            ),
            ["table_owner", "table_name", "column_name"],
        )
        .join(
            tables["tbl"].select(F.col("owner").alias("table_owner"), "table_name"),
            ["table_owner", "table_name"],
            "left_semi",
        )
        .groupBy(*key)
        .agg(F.sum("avg_col_len").alias("avg_row_len"), F.sum(rowset).alias("avg_rowset_len"))
    )
    segments = tables["index_segment"].select(
        "owner", F.col("segment_name").alias("index_name"), "bytes"
    )
    # hundredths of a byte, so that the free-space percentage stays a whole number
    estimate = F.col("num_rows") * (ENTRY_BYTES * 100) + F.col("avg_rowset_len") * (
        F.lit(100) + F.col("pct_free")
    )
    return (
        idx.join(segments, key)
        .join(rows, key, "left")
        .select(
            F.col("owner").alias("index_owner"),
            "index_name",
            "partitioned",
            "num_rows",
            "distinct_keys",
            "avg_row_len",
            "blevel",
            "leaf_blocks",
            half_up(F.col("bytes"), scale=MIB, digits=3).alias("allocated_for_segment_mb"),
            half_up(F.col("num_rows") * F.col("avg_row_len"), scale=MIB, digits=3).alias(
                "used_by_data_mb"
            ),
            half_up(estimate, 100, scale=MIB, digits=3).alias("estimated_index_size_mb"),
            half_up(estimate, F.col("bytes"), digits=2).alias("pct_used"),
        )
        .orderBy(F.col("pct_used").asc_nulls_last(), "index_owner", "index_name")
    )


def index_usage(
    tables: Tables,
    *,
    table_name: str | None = None,
    not_in_plans: bool = False,
    unused_for: timedelta | None = None,
    as_of: datetime | None = None,
) -> DataFrame:
    """Size, constraint, use and change rate of each index.

    ``not_in_plans`` keeps the indexes no stored plan step names. ``unused_for`` keeps those not
    used since ``as_of`` minus that time: watched and never used, without any known use, or last
    used before it. That no use is known counts only if the use of indexes is collected at all, which
    is looked up inside the plan.
    """
    if unused_for is not None and as_of is None:
        raise ValueError("unused_for needs as_of")
    key = ["index_owner", "index_name"]
    idx = tables["idx"] if table_name is None else tables["idx"].where(F.col("table_name") == table_name)
    idx = idx.select(
        F.col("owner").alias("index_owner"), "index_name", "uniqueness", "table_owner", "table_name"
    )
    if not_in_plans:
        plans = [tables[n] for n in ("plan_line", "plan_line_hist") if n in tables]
        named = [p.select("object_owner", "object_name") for p in plans]
        seen = named[0] if len(named) == 1 else named[0].unionByName(named[1])
        seen = seen.distinct().toDF(*key)
        idx = idx.join(seen, key, "left_anti")
    tbl = tables["tbl"].select(
        F.col("owner").alias("table_owner"), "table_name", "last_analyzed", "monitoring"
    )
    segments = tables["index_segment"].select(
        F.col("owner").alias("index_owner"), F.col("segment_name").alias("index_name"), "bytes"
    )
    sized = (
        idx.join(tbl, ["table_owner", "table_name"])
        .join(segments, key)
        .groupBy(*key, "uniqueness", "table_owner", "table_name", "last_analyzed", "monitoring")
        .agg(half_up(F.sum("bytes"), scale=MIB, digits=3).alias("index_total_mb"))
    )
    used = tables["index_usage"].select(
        F.col("owner").alias("index_owner"),
        F.col("name").alias("index_name"),
        F.col("last_used").alias("last_index_used"),
    )
    watched = tables["object_usage"].select(
        "index_name",
        "table_name",
        F.col("monitoring").alias("idx_monitoring"),
        F.col("used").alias("index_used"),
        F.to_timestamp("start_monitoring", "MM/dd/yyyy HH:mm:ss").alias(
            "start_index_monitoring"
        ),
    )
    changed = (
        tables["tab_modification"]
        .where("partition_name is null")
        .select(
            "table_owner",
            "table_name",
            F.col("modified_at").alias("last_data_modification"),
            "inserts",
            "updates",
            "deletes",
        )
    )
    constraints = tables["constraint_def"].select(*key, "constraint_type")
    rows = (
        sized.join(used, key, "left")
        .join(watched, ["index_name", "table_name"], "left")
        .join(changed, ["table_owner", "table_name"], "left")
        .join(constraints, key, "left")
    )
    if unused_for is not None:
        collected = tables["index_usage_info"].where("index_stats_enabled = 1").exists()
        rows = rows.where(
            (F.col("index_used").isNull() & (F.col("idx_monitoring") == "YES"))
            | (F.col("last_index_used").isNull() & collected)
            | (F.col("last_index_used") <= ts_lit(as_of - unused_for))
        )
    micros = F.unix_micros("last_data_modification") - F.unix_micros("last_analyzed")
    touched = F.col("inserts") + F.col("updates") + F.col("deletes")
    return rows.select(
        *key,
        "table_name",
        "uniqueness",
        "constraint_type",
        "index_total_mb",
        F.col("monitoring").alias("tbl_monitoring"),
        "idx_monitoring",
        "index_used",
        "start_index_monitoring",
        "last_index_used",
        "last_analyzed",
        "last_data_modification",
        "inserts",
        "updates",
        "deletes",
        half_up(touched.cast(WIDE) * F.lit(60_000_000), micros).alias("row_modified_per_minute"),
    ).orderBy(F.col("index_total_mb").desc_nulls_last(), *key)
