"""Components of a graph whose links are a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadlens.llm.common import stored

#: Parts that the rows of one label are dealt into when they look up what belongs to the label.
SALTS = 16


def looked_up(rows: DataFrame, key: str, found: DataFrame, spread: Column) -> DataFrame:
    """``rows`` with the columns of ``found``, which has one row a ``key``; a key with most of all rows is split.

    ``spread`` tells the rows of one key apart. Rows whose key has no partner go.
    """
    salted = found.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    return own.join(salted, [key, "_salt"]).drop("_salt")


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``comp``, the least node reachable, of all nodes with links; links are ``a``, ``b``.

    Each turn takes the least label around and then the label of that label, so the way to the least
    node halves at least. Only distinct labels are looked up.
    """
    both = stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp"))
    labels = stored(labels, "labels")
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), "comp"), "b")
        around = around.groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("seen"))
        step = labels.join(around, "node").select("node", F.col("comp").alias("old"), F.least("comp", "seen").alias("comp"))
        step = stored(step, "steps")
        wanted = step.select(F.col("comp").alias("node")).distinct()
        further = step.select("node", F.col("comp").alias("further")).join(wanted, "node").withColumnRenamed("node", "comp")
        step = looked_up(step, "comp", further, F.col("node"))
        step = step.select("node", F.col("further").alias("comp"), (F.col("further") != F.col("old")).alias("moved"))
        step = stored(step, "labels")
        labels = step.select("node", "comp")
        if not step.filter("moved").limit(1).count():
            return labels
