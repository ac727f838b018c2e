"""Reports on space, buffers and damaged extents."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadlens.functions import half_up
from loadlens.operators.common import Tables, broadcast_if_small, only

MIB = 1024 * 1024

# Labels of buffer classes by class number. Other classes have no label.
BUFFER_CLASSES = {
    1: "data block",
    2: "sort block",
    3: "save undo block",
    4: "segment header",
    5: "save undo header",
    6: "free list",
    7: "extent map",
    8: "1st level bmb",
    9: "2nd level bmb",
    10: "3rd level bmb",
    11: "bitmap block",
    12: "bitmap index block",
    13: "file header block",
    14: "unused",
    15: "system undo header",
    16: "system undo block",
    17: "undo header",
    18: "undo block",
}


def _bytes_by_tablespace(df: DataFrame) -> DataFrame:
    return df.groupBy("tablespace_name").agg(F.sum("bytes").alias("bytes"))


def _whole_mib() -> Column:
    return half_up(F.col("bytes"), scale=MIB)


def tablespace_usage(tables: Tables) -> DataFrame:
    """Used, free and total MB of each tablespace that holds segments."""
    total = _bytes_by_tablespace(tables["data_file"]).select(
        "tablespace_name", _whole_mib().alias("total_mb")
    )
    used = _bytes_by_tablespace(tables["segment"]).select(
        "tablespace_name", _whole_mib().alias("used_mb")
    )
    free = F.col("total_mb") - F.col("used_mb")
    return total.join(used, "tablespace_name").select(
        F.col("tablespace_name").alias("tablespace"),
        "used_mb",
        free.alias("free_mb"),
        "total_mb",
        half_up(free * 100, F.col("total_mb")).alias("pct_free"),
    )


def tablespace_free(tables: Tables) -> DataFrame:
    """Size and free MB of every tablespace with data or temporary files."""
    size = (
        _bytes_by_tablespace(tables["data_file"])
        .unionByName(_bytes_by_tablespace(tables["temp_file"]))
        .distinct()
        .select("tablespace_name", (F.col("bytes") / F.lit(float(MIB))).alias("size_mb"))
    )
    free = _bytes_by_tablespace(tables["free_space"]).select(
        "tablespace_name", half_up(F.col("bytes"), scale=MIB, digits=2).alias("free_mb")
    )
    return size.join(free, "tablespace_name", "left")


def buffer_summary(tables: Tables, *, object_names: Iterable[str] | None = None) -> DataFrame:
    """Cached buffers per object by class, status and flags, with the total of the object.

    Buffers are counted per object id before they meet the object names, so an object that fills
    most of the cache is a few rows by then.
    """
    state = ["status", "dirty", "temp", "ping", "stale", "direct", "new"]
    labels = F.create_map(*[F.lit(x) for pair in BUFFER_CLASSES.items() for x in pair])
    counted = (
        tables["buffer_header"]
        .groupBy("objd", F.try_element_at(labels, F.col("class_id")).alias("block_class"), *state)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    objects = only(tables["object"], "object_name", object_names).select(
        F.col("data_object_id").alias("objd"), "object_name"
    )
    per_object = Window.partitionBy("object_name")
    return (
        counted.join(objects, "objd")
        .groupBy("object_name", "block_class", *state)
        .agg(F.sum("n").alias("blkcount"))
        .withColumn("blkcount_total", F.sum("blkcount").over(per_object))
    )


def corrupt_extents(tables: Tables) -> DataFrame:
    """Extents that start at a block of the corruption list."""
    damaged = broadcast_if_small(tables["corruption"].select("file_id", "block_id"))
    extents = tables["extent"]
    return extents.join(damaged, ["file_id", "block_id"], "left_semi").select(*extents.columns)
