"""Table profiles: the column statistics the size and upkeep reports need, gathered by Spark."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadlens.functions import half_up, ts_lit

# Stored bytes of the fixed-width types.
WIDTHS = {
    T.BooleanType: 1,
    T.ByteType: 1,
    T.ShortType: 2,
    T.IntegerType: 4,
    T.FloatType: 4,
    T.DateType: 4,
    T.LongType: 8,
    T.DoubleType: 8,
    T.TimestampType: 8,
    T.TimestampNTZType: 8,
    T.DayTimeIntervalType: 8,
    T.YearMonthIntervalType: 4,
}

# Most digits of the decimals stored in 4 and in 8 bytes; longer ones take 16.
DECIMAL_DIGITS = {4: 9, 8: 18}

# Types without an order that a lowest and highest value could follow.
_NESTED = (T.ArrayType, T.MapType, T.StructType)

# Binary logarithm of the cells of a distinct-count sketch: an error of about 1.04 / sqrt(2**12), 1.6 percent.
SKETCH_BITS = 12

# Longer text is counted by its SHA-256 digest, so the exchange carries 64 bytes for it.
_LONG_TEXT = 64


def _excluded(tables: Mapping[str, DataFrame], exclude: Iterable[str] | DataFrame) -> set[str]:
    """The given names to leave out; a DataFrame is reduced to those names before it is fetched."""
    if isinstance(exclude, DataFrame):
        named = exclude.select("table_name").where(F.col("table_name").isin(list(tables)))
        return {row["table_name"] for row in named.distinct().collect()}
    return set(exclude)


def _comparable(field: T.StructField) -> Column:
    """The column in a form that can be compared: nested values as their JSON text."""
    nested = isinstance(field.dataType, _NESTED)
    return F.to_json(F.col(field.name)) if nested else F.col(field.name)


def _width(kind: T.DataType) -> int | None:
    """Stored bytes of a fixed-width type; None for all others."""
    if isinstance(kind, T.DecimalType):
        return next((n for n, digits in DECIMAL_DIGITS.items() if kind.precision <= digits), 16)
    return WIDTHS.get(type(kind))


def _size(field: T.StructField) -> Column:
    """Stored bytes of a value: its type's width, elements times theirs, else its bytes as text."""
    width = _width(field.dataType)
    if width is not None:
        return F.lit(width)
    if isinstance(field.dataType, T.ArrayType) and (each := _width(field.dataType.elementType)):
        return F.size(field.name) * each
    return F.octet_length(_comparable(field))


def _one_zero(field: T.StructField) -> Column:
    """The comparable column with one zero, not two."""
    value = _comparable(field)
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        value = value + F.lit(0.0).cast(field.dataType)
    return value


def _as_text(field: T.StructField) -> Column:
    value = _one_zero(field)
    return F.base64(value) if isinstance(field.dataType, T.BinaryType) else value.cast("string")


def _bytes_of(field: T.StructField) -> Column:
    return F.sum(F.when(F.col(field.name).isNotNull(), _size(field)).otherwise(0)).cast("bigint")


def _exact_distinct(df: DataFrame) -> DataFrame:
    """Distinct values per column position: one exchange of the distinct (position, value) pairs."""
    values = []
    for i, field in enumerate(df.schema.fields):
        text = _as_text(field)
        long = F.length(text) > _LONG_TEXT
        digest = F.when(long, F.sha2(text, 256)).otherwise(text)
        # A digest is told apart from a text that reads the same.
        values.append(F.struct(F.lit(i).alias("position"), long.alias("long"), digest.alias("value")))
    return (
        df.select(F.inline(F.array(*values)))
        .where("value is not null")
        .distinct()
        .groupBy("position")
        .agg(F.count(F.lit(1)).alias("num_distinct"))
    )


def _profile_one(
    owner: str | None, name: str, df: DataFrame, exact_distinct: bool, rsd: float
) -> DataFrame:
    aggregates, lines = [F.count(F.lit(1)).alias("num_rows")], []
    for i, field in enumerate(df.schema.fields):
        value = _comparable(field)
        ordered = F.lit(None).cast("string") if isinstance(field.dataType, _NESTED) else value
        aggregates += [
            F.count_if(F.col(field.name).isNull()).alias(f"nulls_{i}"),
            _bytes_of(field).alias(f"bytes_{i}"),
            F.min(ordered).cast("string").alias(f"min_{i}"),
            F.max(ordered).cast("string").alias(f"max_{i}"),
        ]
        if not exact_distinct:
            aggregates.append(F.approx_count_distinct(value, rsd).alias(f"distinct_{i}"))
        lines.append(
            F.struct(
                F.lit(i).alias("position"),
                F.lit(field.name).alias("column_name"),
                F.col(f"nulls_{i}").alias("num_nulls"),
                (F.lit(None).cast("bigint") if exact_distinct else F.col(f"distinct_{i}")).alias(
                    "num_distinct"
                ),
                half_up(F.col(f"bytes_{i}"), F.col("num_rows")).alias("avg_col_len"),
                F.col(f"min_{i}").alias("min_value"),
                F.col(f"max_{i}").alias("max_value"),
            )
        )
    profile = df.agg(*aggregates).select("num_rows", F.inline(F.array(*lines)))
    if exact_distinct:
        counted = profile.drop("num_distinct").join(_exact_distinct(df), "position", "left")
        profile = counted.withColumn(
            "num_distinct", F.coalesce("num_distinct", F.lit(0).cast("bigint"))
        )
    return profile.select(
        *([] if owner is None else [F.lit(owner).cast("string").alias("owner")]),
        F.lit(name).alias("table_name"),
        "column_name",
        "num_rows",
        "num_nulls",
        "num_distinct",
        "avg_col_len",
        "min_value",
        "max_value",
    )


def table_profile(
    tables: Mapping[str, DataFrame],
    *,
    as_of: datetime,
    owner: str | None = None,
    exclude: Iterable[str] | DataFrame = (),
    exact_distinct: bool = False,
    rsd: float = 0.02,
) -> DataFrame:
    """Per table and column: rows, NULLs, distinct values, average bytes, lowest and highest value.

    Fixed-width types count their stored width, arrays of them that times their length, everything
    else the bytes of its text. Nested values have no lowest and highest.

    Each table is read once, in one aggregation without a shuffle of its rows. Distinct values are
    estimated within ``rsd``; ``exact_distinct`` counts them instead, with a second read that
    shuffles every distinct value. ``exclude`` names tables to leave out, as names or as a DataFrame
    with ``table_name``. The first column is ``owner``, where one is given.
    """
    left_out = _excluded(tables, exclude)
    profiles = [
        _profile_one(owner, name, df, exact_distinct, rsd)
        for name, df in tables.items()
        if name not in left_out
    ]
    if not profiles:
        raise ValueError("every table is excluded")
    return reduce(DataFrame.unionByName, profiles).withColumn("last_analyzed", ts_lit(as_of))


def _limit(field: T.StructField) -> Column:
    """A value with what its type is ordered by, so that the least and greatest of several parts can be found.

    NULL for nested values and for intervals of months.
    """
    column, kind = F.col(field.name), field.dataType
    whole = fraction = real = None
    if isinstance(kind, T.IntegralType):
        whole = column
    elif isinstance(kind, T.DateType):
        whole = F.unix_date(column)
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        whole = F.unix_micros(column.cast("timestamp"))
    elif isinstance(kind, T.DayTimeIntervalType):
        whole = F.unix_micros(F.timestamp_micros(F.lit(0)) + column)
    elif isinstance(kind, T.DecimalType):
        whole, fraction = F.floor(column), column - F.floor(column)
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        real = column.cast("double")
    parts = ((whole, "decimal(38,0)", "whole"), (fraction, "decimal(38,38)", "fraction"), (real, "double", "real"))
    order = [(F.lit(None) if c is None else c).cast(t).alias(n) for c, t, n in parts]
    ordered = not isinstance(kind, (*_NESTED, T.YearMonthIntervalType))
    return F.when(column.isNotNull() & F.lit(ordered), F.struct(*order, column.cast("string").alias("shown")))


def profile_parts(
    tables: Mapping[str, DataFrame], *, owner: str | None = None, part: Mapping[str, str] | None = None
) -> DataFrame:
    """What a profile needs to know of each part of each table, in a form that can be merged.

    ``part`` names the column of a table whose values tell its parts; a table without one is one part
    (NULL). Each table is read once; a part's column takes one row with counts, limits and a sketch
    of its distinct values. Stored by day, a new day is read alone and ``merged_profile`` covers all.
    """
    done = []
    for name, df in tables.items():
        at = (part or {}).get(name)
        aggregates, lines = [F.count(F.lit(1)).alias("num_rows")], []
        for i, field in enumerate(df.schema.fields):
            aggregates += [
                F.count_if(F.col(field.name).isNull()).alias(f"nulls_{i}"),
                _bytes_of(field).alias(f"bytes_{i}"),
                F.min(_limit(field)).alias(f"low_{i}"),
                F.max(_limit(field)).alias(f"high_{i}"),
                F.hll_sketch_agg(_as_text(field), SKETCH_BITS).alias(f"sketch_{i}"),
            ]
            lines.append(
                F.struct(
                    F.lit(i).alias("position"),
                    F.lit(field.name).alias("column_name"),
                    F.col("num_rows"),
                    F.col(f"nulls_{i}").alias("num_nulls"),
                    F.col(f"bytes_{i}").alias("bytes"),
                    F.col(f"low_{i}").alias("low"),
                    F.col(f"high_{i}").alias("high"),
                    F.col(f"sketch_{i}").alias("sketch"),
                )
            )
        key = F.lit(None).cast("string") if at is None else F.col(at).cast("string")
        counted = df.groupBy(key.alias("part")).agg(*aggregates)
        done.append(
            counted.select(
                F.lit(owner).cast("string").alias("owner"),
                F.lit(name).alias("table_name"),
                "part",
                F.inline(F.array(*lines)),
            )
        )
    return reduce(DataFrame.unionByName, done)


def merged_profile(parts: DataFrame, *, as_of: datetime) -> DataFrame:
    """``table_profile`` of all parts together, from ``profile_parts`` rows alone.

    Everything is exact but ``num_distinct``, which the union of the sketches estimates within about
    1.6 percent (one standard deviation).
    """
    merged = parts.groupBy("owner", "table_name", "position", "column_name").agg(
        F.sum("num_rows").alias("num_rows"),
        F.sum("num_nulls").alias("num_nulls"),
        F.sum("bytes").alias("bytes"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("num_distinct"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
    )
    return merged.select(
        "owner",
        "table_name",
        "column_name",
        "num_rows",
        "num_nulls",
        "num_distinct",
        half_up(F.col("bytes"), F.col("num_rows")).alias("avg_col_len"),
        F.col("low.shown").alias("min_value"),
        F.col("high.shown").alias("max_value"),
        ts_lit(as_of).alias("last_analyzed"),
    )


@dataclass(frozen=True)
class Index:
    """A declared index: the key columns, in order, of a table."""

    owner: str
    name: str
    table: str
    columns: tuple[str, ...]
    unique: bool = False
    pct_free: int = 10


def _key_text(df: DataFrame, columns: Iterable[str]) -> Column:
    """The values of a key as one text; long ones as a digest, told apart from a text that reads the same."""
    values = [_one_zero(df.schema[c]).alias(c) for c in columns]
    text = F.to_json(F.struct(*values))
    long = F.length(text) > _LONG_TEXT
    return F.struct(long.alias("long"), F.when(long, F.sha2(text, 256)).otherwise(text).alias("text"))


def index_profile(
    tables: Mapping[str, DataFrame], indexes: Iterable[Index], *, table_owner: str
) -> DataFrame:
    """Entries and distinct keys of each declared index, as the rows of ``idx``.

    A row whose key columns are all NULL has no entry. All indexes of a table are counted in one read
    and one exchange of distinct (index, key) pairs, combined before it. ``blevel`` and
    ``leaf_blocks`` belong to storage and stay NULL.
    """
    found, indexes = [], list(indexes)
    for name in dict.fromkeys(i.table for i in indexes):
        df, own = tables[name], [i for i in indexes if i.table == name]
        keys = [
            F.struct(
                F.lit(k).alias("position"),
                reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in i.columns]).alias("held"),
                _key_text(df, i.columns).alias("key"),
            )
            for k, i in enumerate(own)
        ]
        entries = df.select(F.inline(F.array(*keys))).where("held")
        counted = (
            entries.groupBy("position", "key")
            .agg(F.count(F.lit(1)).alias("n"))
            .groupBy("position")
            .agg(F.sum("n").alias("num_rows"), F.count(F.lit(1)).alias("distinct_keys"))
        )
        listed = df.sparkSession.createDataFrame(
            [
                (k, i.owner, i.name, table_owner, name, "UNIQUE" if i.unique else "NONUNIQUE", "NO", i.pct_free)
                for k, i in enumerate(own)
            ],
            "position int, owner string, index_name string, table_owner string, table_name string, "
            "uniqueness string, partitioned string, pct_free bigint",
        )
        found.append(listed.join(counted, "position", "left"))
    none, zero = F.lit(None).cast("bigint"), F.lit(0).cast("bigint")
    return reduce(DataFrame.unionByName, found).select(
        "owner",
        "index_name",
        "table_owner",
        "table_name",
        "uniqueness",
        "partitioned",
        F.coalesce("num_rows", zero).alias("num_rows"),
        F.coalesce("distinct_keys", zero).alias("distinct_keys"),
        none.alias("blevel"),
        none.alias("leaf_blocks"),
        "pct_free",
    )


def profiled_catalog(
    spark: SparkSession,
    tables: Mapping[str, DataFrame],
    indexes: Iterable[Index],
    *,
    owner: str,
    as_of: datetime,
) -> dict[str, DataFrame]:
    """The catalog tables that ``index_size_estimate`` reads, gathered from the data itself.

    All of them but ``index_segment``, which is what storage allocated.
    """
    indexes = list(indexes)
    idx = index_profile(tables, indexes, table_owner=owner)
    columns = [(i.owner, i.name, c) for i in indexes for c in i.columns]
    named = {i.table: tables[i.table] for i in indexes}
    profile = table_profile(named, as_of=as_of, owner=owner)
    return {
        "idx": idx,
        "ind_column": spark.createDataFrame(columns, "index_owner string, index_name string, column_name string"),
        "ind_stat": idx.select("owner", "index_name", F.lit(None).cast("string").alias("partition_name"), "num_rows"),
        "col_stat": profile.select("owner", "table_name", "column_name", "avg_col_len", "num_nulls"),
        "tbl": profile.select("owner", "table_name", "last_analyzed").distinct(),
    }
