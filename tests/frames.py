"""Small hand-made telemetry tables."""

from __future__ import annotations

from datetime import datetime, timedelta

from loadlens.sources import SCHEMAS

DAY = datetime(2024, 1, 10)


def frame(spark, name, rows=()):
    """A telemetry table from dicts; columns left out are NULL, the database is 1."""
    empty = spark.createDataFrame([], SCHEMAS[name])
    data = [tuple(row.get(c, 1 if c == "dbid" else None) for c in empty.columns) for row in rows]
    unknown = {k for row in rows for k in row} - set(empty.columns)
    assert not unknown, unknown
    return spark.createDataFrame(data, empty.schema)


def snap(snap_id, begin, hours=1, instance=1, dbid=1):
    return {
        "dbid": dbid,
        "instance_number": instance,
        "snap_id": snap_id,
        "begin_interval_time": begin,
        "end_interval_time": begin + timedelta(hours=hours),
        "startup_time": datetime(2023, 12, 1),
    }


def at(snap_id, instance=1, dbid=1):
    return {"dbid": dbid, "instance_number": instance, "snap_id": snap_id}


def rows(df, *columns):
    picked = df.select(*columns) if columns else df
    return [tuple(r) for r in picked.collect()]


def row_set(df, *columns):
    return sorted(rows(df, *columns), key=repr)
