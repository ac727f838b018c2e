"""Storing intermediate tables and reading the given ones."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
import zlib
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder ``spark.checkpoint.dir`` names; a temporary one only in a local session that names none.

    What is stored there stays until the folder is cleared. On a cluster a folder must be named, for
    executors do not see one another's disks.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    This cuts the lineage: an executor lost later costs no recomputation, and values that
    depend on the order of rows stay fixed from here on.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(key: str, folds: int) -> Column:
    """``crc32`` of a key written as text, modulo the number of folds."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(folds))


def in_fold(key: int, folds: int) -> int:
    """``fold_of`` of one key."""
    return zlib.crc32(str(key).encode()) % folds


#: Rows and bytes that Python workers get at once.
BATCH = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def shipped(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once a session, so that their Python finds it; bound their batches."""
    for name, value in BATCH.items():
        spark.conf.set(name, value)
    context = spark.sparkContext
    if not any("loadlens_code" in name for name in context.listFiles):
        package = Path(__file__).resolve().parents[1]
        place = Path(tempfile.mkdtemp(prefix="loadlens-")) / "loadlens_code.zip"
        with zipfile.ZipFile(place, "w") as file:
            for source in sorted(package.rglob("*.py")):
                file.write(source, source.relative_to(package.parent))
        context.addPyFile(str(place))
    return spark
