"""Shapes shared by several reports."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, replace
from datetime import date, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType, VariantType

from loadlens.functions import ts_lit
from loadlens.sources.store import SNAP_KEYS, prune_days

Tables = Mapping[str, DataFrame]

# Session setting: the most bytes a side may have to be broadcast, and its default.
SMALL_BYTES = "spark.loadlens.broadcastBytes"
SMALL_BYTES_DEFAULT = 128 * 1024 * 1024


# Columns of other types have no length that can be added up, so a side with one is never proven small.
_SIZED = (StringType, BinaryType)
_UNSIZED = (ArrayType, MapType, StructType, VariantType)


def _bytes(df: DataFrame) -> Column:
    """Bytes the rows take in Spark's row format: a word per column, the text, and the row's frame.

    NULL if a column's values have no known length.
    """
    if any(isinstance(f.dataType, _UNSIZED) for f in df.schema):
        return F.lit(None).cast("bigint").alias("bytes")
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema if isinstance(f.dataType, _SIZED)]
    fixed = F.lit(16 + 8 * len(df.columns)).cast("bigint")
    return F.coalesce(F.sum(reduce(Column.__add__, texts, fixed)), F.lit(0)).alias("bytes")


def _fits(spark: SparkSession, size: int | None) -> bool:
    return size is not None and size <= int(spark.conf.get(SMALL_BYTES, str(SMALL_BYTES_DEFAULT)))


def is_small(df: DataFrame) -> bool:
    """Whether a join side is proven small enough to broadcast, by adding up its rows.

    Spark's own estimate of a filtered or aggregated side can be far too high, and by the time its
    true size is known at run time the large side has already been shuffled.
    """
    return _fits(df.sparkSession, df.agg(_bytes(df)).first()["bytes"])


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """The side with a broadcast hint if it is proven small; as it is otherwise."""
    return F.broadcast(df) if is_small(df) else df


def settled(df: DataFrame) -> DataFrame:
    """The rows kept in the checkpoint folder, for a side that is used several times.

    The folder is the one the session names in ``spark.checkpoint.dir``. Without one the rows are
    computed again on each use.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            return df
        context.setCheckpointDir(folder)
    return df.checkpoint()


def only(df: DataFrame, column: str, values: Iterable | None) -> DataFrame:
    """Rows whose column is one of the values; all rows when no values are given."""
    return df if values is None else df.where(F.col(column).isin(list(values)))


@dataclass(frozen=True)
class SnapWindow:
    """Rows by snapshot that a fact is joined to, measured before the join is planned.

    ``rows`` has a broadcast hint if they are ``few``. ``keep`` narrows a fact to the range of their
    snapshot ids, and to their days where it is stored by day; both are filters the scan can use to
    skip data, implied by the join that follows.
    """

    rows: DataFrame
    few: bool
    low: int | None
    high: int | None
    first: date | None = None
    last: date | None = None

    def keep(self, fact: DataFrame, *, keep_unknown: bool = False) -> DataFrame:
        ids = F.col("snap_id").between(F.lit(self.low), F.lit(self.high))
        return prune_days(fact, self.first, self.last, keep_unknown=keep_unknown).where(ids)

    def join(self, fact: DataFrame) -> DataFrame:
        """The covered fact rows with the wanted snapshot columns.

        The join is on the full snapshot key: a broadcast join where the snapshots are proven few,
        and a sort-merge join, whose hot snapshots Spark splits at run time, beyond that.
        """
        return self.keep(fact).join(self.rows, SNAP_KEYS)


def measured(
    rows: DataFrame,
    first: date | None = None,
    last: date | None = None,
    *,
    low: str = "snap_id",
    high: str = "snap_id",
) -> SnapWindow:
    """The rows with their size and range of snapshot ids, found by one aggregation of them."""
    size = rows.agg(_bytes(rows), F.min(low).alias("low"), F.max(high).alias("high")).first()
    few = _fits(rows.sparkSession, size["bytes"])
    hinted = F.broadcast(rows) if few else rows
    return SnapWindow(hinted, few, size["low"], size["high"], first, last)


def with_days(window: SnapWindow, snapshot: DataFrame) -> SnapWindow:
    """The window with the first and last day on which its snapshots began."""
    days = snapshot.where(F.col("snap_id").between(F.lit(window.low), F.lit(window.high))).agg(
        F.min(F.to_date("begin_interval_time")).alias("first"),
        F.max(F.to_date("begin_interval_time")).alias("last"),
    )
    found = days.first()
    return replace(window, first=found["first"], last=found["last"])


def window_of(
    snapshot: DataFrame, btime: datetime | None, etime: datetime | None, *columns: str
) -> SnapWindow:
    """The snapshots that begin in the window; a side given as None is open."""
    if btime is not None:
        snapshot = snapshot.where(F.col("begin_interval_time") >= ts_lit(btime))
    if etime is not None:
        snapshot = snapshot.where(F.col("begin_interval_time") <= ts_lit(etime))
    return measured(snapshot.select(*SNAP_KEYS, *columns), btime, etime)


def shared(names: Iterable[str], *frames: DataFrame) -> list[str]:
    """Those of the names that every frame has; used to add ``dbid`` to a key where it is kept."""
    return [n for n in names if all(n in f.columns for f in frames)]
