"""Validation of stored datasets, one after the other, with a verdict for each, and of an index against its table."""

from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("TABLE", "INDEX")

_RESULT = (
    "position string, owner string, object_name string, object_type string, num_rows bigint, "
    "null_keys bigint, duplicate_keys bigint, status string, message string"
)


@dataclass(frozen=True)
class Dataset:
    """A stored dataset and, optionally, the columns that should identify its rows.

    An index can name its table in ``of``: it then has an entry, ``keys`` and the columns ``locator``
    that identify the table's row, for each row of the table.
    """

    owner: str
    name: str
    path: str
    kind: str = "TABLE"
    format: str = "parquet"
    keys: tuple[str, ...] = field(default=())
    of: Dataset | None = None
    locator: tuple[str, ...] = field(default=())


#: Buckets whose digests are compared first; at most so many numbers are sent to all tasks.
BUCKETS = 4096


def index_discrepancies(
    table: DataFrame,
    index: DataFrame,
    *,
    keys: Iterable[str],
    locator: Iterable[str],
    buckets: int = BUCKETS,
) -> DataFrame:
    """Entries of an index that do not match the rows of its table: the locator, ``verdict`` and counts.

    Verdicts: ``lost`` (a row without its entry), ``doubled`` (more entries alike than rows),
    ``changed`` (an entry of the row with another key instead) and ``stray`` (an entry with a key
    or locator that no row has, besides the right ones).

    Both sides are dealt into buckets by a hash of the locator. A bucket's digest, a count and sums
    of row hashes, does not depend on the order of rows, is combined where they lie, and costs a row
    a bucket to exchange. Rows are moved and compared only in buckets whose digests differ.
    """
    keys, locator = list(keys), list(locator)
    bucket = F.pmod(F.xxhash64(*locator), F.lit(buckets)).alias("_bucket")

    def side(df: DataFrame, of_table: int) -> DataFrame:
        return df.select(*locator, *keys, bucket, F.lit(of_table).cast("bigint").alias("_t"), F.lit(1 - of_table).cast("bigint").alias("_i"))

    both = side(table, 1).unionByName(side(index, 0))
    sign = F.col("_t") - F.col("_i")
    hashes = [F.xxhash64(F.lit(k), *locator, *keys).cast("decimal(38,0)") for k in range(2)]
    sums = both.groupBy("_bucket").agg(
        F.sum(sign).alias("n"), *[F.sum(h * sign).alias(f"h{k}") for k, h in enumerate(hashes)]
    )
    unlike = sums.where("n <> 0 or h0 <> 0 or h1 <> 0").select("_bucket")
    # At most a number a bucket.
    doubtful = both.join(F.broadcast(unlike), "_bucket", "left_semi")
    alike = doubtful.groupBy(*locator, *keys).agg(F.sum("_t").alias("t"), F.sum("_i").alias("i")).where("t <> i")
    found = alike.groupBy(*locator).agg(
        F.sum(F.greatest(F.col("t") - F.col("i"), F.lit(0))).alias("rows_without_entry"),
        F.sum(F.greatest(F.col("i") - F.col("t"), F.lit(0))).alias("entries_without_row"),
        F.max((F.col("t") == 0) & (F.col("i") > 0)).alias("foreign"),
    )
    missing = F.col("rows_without_entry") > 0
    verdict = (
        F.when(missing & F.col("foreign"), "changed")
        .when(missing, "lost")
        .when(F.col("foreign"), "stray")
        .otherwise("doubled")
    )
    return found.select(*locator, verdict.alias("verdict"), "rows_without_entry", "entries_without_row")


def _holds_map(kind: T.DataType) -> bool:
    """Whether a type is a map or has one anywhere inside; maps cannot be hashed."""
    if isinstance(kind, T.ArrayType):
        return _holds_map(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_holds_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType)


def _is_damage(error: Exception) -> bool:
    """Whether the error, or the task failure it reports, says that a stored file cannot be read."""
    return "[FAILED_READ_FILE" in str(error)


def _loaded(spark: SparkSession, dataset: Dataset) -> DataFrame:
    reader = spark.read.format(dataset.format)
    return reader.option("ignoreCorruptFiles", "false").option("ignoreMissingFiles", "false").load(dataset.path)


def _unmatched(spark: SparkSession, dataset: Dataset) -> str:
    """What an index has wrong against its table, counted by verdict; empty if nothing."""
    found = index_discrepancies(
        _loaded(spark, dataset.of), _loaded(spark, dataset), keys=dataset.keys, locator=dataset.locator
    )
    counts = {r["verdict"]: r["count"] for r in found.groupBy("verdict").count().collect()}  # 4 rows at most
    return ", ".join(f"{counts[v]} {v}" for v in ("lost", "doubled", "changed", "stray") if v in counts)


def _read_whole(spark: SparkSession, dataset: Dataset) -> tuple[int, int | None, int | None]:
    """Decode every column of every row; count rows, rows with a NULL key and repeated keys."""
    df = _loaded(spark, dataset)
    every_column = F.xxhash64(
        *[F.to_json(F.struct(f.name)) if _holds_map(f.dataType) else F.col(f.name) for f in df.schema]
    )
    counts = [F.count(F.lit(1)).alias("n"), F.bit_xor(every_column).alias("digest")]
    identified = dataset.keys and dataset.of is None  # an index may repeat keys and hold NULL
    if identified:
        has_null = F.greatest(*[F.col(k).isNull() for k in dataset.keys], F.lit(False))
        key = F.when(~has_null, F.struct(*dataset.keys))
        counts += [F.count_if(has_null).alias("null_keys"), F.countDistinct(key).alias("keys")]
    row = df.agg(*counts).first()
    if not identified:
        return row["n"], None, None
    return row["n"], row["null_keys"], row["n"] - row["null_keys"] - row["keys"]


def _verdict(spark: SparkSession, dataset: Dataset, position: str) -> tuple:
    head = (position, dataset.owner, dataset.name, dataset.kind)
    label = f"{dataset.kind} {dataset.owner}.{dataset.name}"
    try:
        rows, null_keys, repeated = _read_whole(spark, dataset)
        unmatched = _unmatched(spark, dataset) if dataset.of else ""
    except Exception as error:  # one unreadable dataset must not stop the others
        damaged = _is_damage(error)
        if not damaged and not isinstance(error, AnalysisException):
            raise
        reason = (str(error).strip() or type(error).__name__).splitlines()[0]
        return (*head, None, None, None, "FAILED" if damaged else "ERROR", f"{label} {reason}")
    if null_keys or repeated:
        problem = f"{label} has {null_keys} rows with a NULL key and {repeated} repeated keys"
        return (*head, rows, null_keys, repeated, "FAILED", problem)
    if unmatched:
        problem = f"{label} does not match {dataset.of.owner}.{dataset.of.name}: {unmatched}"
        return (*head, rows, null_keys, repeated, "FAILED", problem)
    return (*head, rows, null_keys, repeated, "OK", f"{label} successfully validated")


def validate_tables(
    spark: SparkSession,
    datasets: Iterable[Dataset],
    *,
    owner: str,
    name: str | None = None,
    workers: int = 4,
) -> DataFrame:
    """Read each selected dataset in full and report whether it is sound.

    ``FAILED`` means damaged files, NULL keys, repeated keys, or an index that does not match its table. ``ERROR`` means that the dataset could
    not be checked: its path or a key column does not exist. Any other error is raised.

    Each dataset is one Spark job; ``workers`` jobs are submitted at a time. Only the verdicts, one
    row per dataset, come back to the driver.
    """
    chosen = [
        d
        for d in datasets
        if d.kind in KINDS and d.owner == owner and (name is None or d.name == name)
    ]
    positions = [
        f"ELEMENT #{i} of {len(chosen)}: {d.owner}.{d.name} ({d.kind})"
        for i, d in enumerate(chosen, start=1)
    ]
    with ThreadPoolExecutor(max_workers=max(1, workers)) as pool:
        verdicts = list(pool.map(lambda d, p: _verdict(spark, d, p), chosen, positions))
    return spark.createDataFrame(verdicts, _RESULT)
