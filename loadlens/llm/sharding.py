"""Sharding by a two-pass external shuffle, in DataFrame functions only.

Pass one scatters rows by a seeded hash into buckets small enough for memory and stores them. Pass
two reads each bucket whole, shuffles it in place (``shuffle`` is a Fisher-Yates shuffle) and lays
the buckets end to end, which makes a uniform order of all rows. Shards are equal cuts of that order,
written whole as files. The registered query writes all documents so and reads its rows from the files.

Law ``rows``: counts of shards differ by one at most. Null ids, empty and null texts, repeated rows
and rows with one key are rows like all others: the scatter hash takes in the row's place in its
input file part, so no key gathers in one bucket. An empty table gives an empty result. Columns of
the input are kept; a column with the name of a new one (``shard``, ``slot``) is replaced.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loadlens.llm.common import shared_folder, stored

SHARDS = 40
SEED = 20
BUCKET_BYTES = 32 << 20
ROW_BYTES = 16


def shuffled(
    rows: DataFrame, size: Column | str, *, shards: int = SHARDS, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED
) -> DataFrame:
    """All rows with ``shard`` (0 to ``shards`` - 1) and ``slot``, the gapless place in the shard.

    ``size`` is the bytes of a row, or names a column with them, from which the number of buckets follows.
    """
    columns = [c for c in rows.columns if c not in ("shard", "slot")]
    kept = rows.select(F.struct(*columns).alias("row"), (F.col(size) if isinstance(size, str) else size).alias("size"))
    kept = stored(kept.withColumn("place", F.monotonically_increasing_id()), "scatter")
    total = kept.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    buckets = max(shards, math.ceil(total[0] / bucket_bytes))

    scattered = kept.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "place"), F.lit(buckets)))
    # One row a bucket: the first place of each in the whole order.
    counts = scattered.groupBy("bucket").agg(F.count("*").alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))

    # A bucket is bounded by its size, and a task holds about one at most. Sorted first, so that its
    # shuffle gives the same order in a second attempt.
    width = max(buckets, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    filled = (
        scattered.repartition(width, "bucket")
        .groupBy("bucket")
        .agg(F.array_sort(F.collect_list(F.struct("place", "row"))).alias("rows"))
        .sortWithinPartitions("bucket")
        .select("bucket", F.shuffle("rows", seed).alias("rows"))
    )
    n = F.lit(total[1])
    at = filled.join(first, "bucket").select("first", F.posexplode("rows").alias("i", "r"))
    at = at.select("r.row.*", (F.col("first") + F.col("i")).alias("__at"))
    shard = F.expr(f"__at * {shards} div {total[1] or 1}").cast("int")
    # The first place of shard s is the least a with a * shards >= s * n.
    start = F.expr(f"(__shard * {total[1]}L + {shards - 1}) div {shards}")
    at = at.withColumn("__shard", shard).withColumn("__slot", F.col("__at") - start)
    return at.select(*columns, F.col("__shard").alias("shard"), F.col("__slot").cast("long").alias("slot"))


def write_shards(rows: DataFrame, path: str, size: Column | str, **options) -> None:
    """Write all rows by shard, straight from their buckets.

    Buckets lie end to end in the shards, so a task writes its buckets without another exchange, each
    file in the order of its slots. A shard is read in order by sorting its files' rows by ``slot``.
    """
    done = shuffled(rows, size, **options).sortWithinPartitions("shard", "slot")
    done.write.option("compression", "zstd").partitionBy("shard").parquet(path)


def read_shards(rows: DataFrame, path: str) -> DataFrame:
    """What ``write_shards`` wrote of ``rows`` to a folder."""
    own = [f for f in rows.schema if f.name not in ("shard", "slot")]
    schema = StructType(own).add("slot", "long").add("shard", "integer")
    return rows.sparkSession.read.schema(schema).parquet(path)


def placed(docs: DataFrame) -> DataFrame:
    """Shards of all documents, written whole to the shared folder; their rows in the columns of the contract."""
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("long")
    path = f"{shared_folder(docs.sparkSession)}/shards-{uuid.uuid4().hex}"
    write_shards(docs, path, size)
    return read_shards(docs, path).select(
        "doc_id", size.alias("size"), F.crc32(F.coalesce(F.col("text").cast("binary"), F.lit(b""))).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
