"""From raw documents to packed sequences, one stored stage after another.

Every stage works on all that the one before it kept and keeps the columns of ``documents``, but for
the last one, which returns the pieces. Nulls, empty and repeated rows are handled as each operator
states; empty tables pass through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loadlens.llm import decontamination, near_dedup, packing, pii, quality_classifier
from loadlens.llm.common import shipped, stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality_classifier.accepted(docs, table(shipped(spark), sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    shipped(spark)
    return near_dedup.deduplicated(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.decontaminated(docs, table(shipped(spark), sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked; every document stays."""
    shipped(spark)
    return pii.masked(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document that is left."""
    shipped(spark)
    return packing.packed(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("personal data", personal_data),
    ("packing", sequences),
]

#: Trained models and tokenizers are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each on the stored result of the one before."""
    docs = table(shipped(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
