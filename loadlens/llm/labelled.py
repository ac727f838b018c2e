"""Labelled rows for training, apart from the held-out fold: all of them or a bounded part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadlens.llm.common import fold_of, stored

#: About this many rows ``training_rows`` gives at most, whatever the size of the corpus.
SAMPLE = 20_000
_RANGE = 1 << 30


def _own(labels: DataFrame, label: str, folds: int, held_out: int) -> DataFrame:
    """``doc_id`` and ``label`` of labelled ids outside the held-out fold, a row each."""
    own = labels.select("doc_id", F.col(label).cast("int").alias("label"))
    own = own.filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (fold_of("doc_id", folds) != held_out))
    return own.groupBy("doc_id").agg(F.max("label").alias("label"))


def all_training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int) -> DataFrame:
    """``doc_id``, ``text`` and ``label`` of every labelled document outside the held-out fold.

    Ids, texts and labels are chosen as by ``training_rows``, but no id is left out. The rows of an
    id all hold its one text.
    """
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("digest"))
    chosen = texts.groupBy("doc_id").agg(F.min("digest").alias("digest"))
    chosen = chosen.join(_own(labels, label, folds, held_out), "doc_id")
    return texts.join(chosen, ["doc_id", "digest"]).select("doc_id", "text", "label")


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int) -> DataFrame:
    """``doc_id``, ``text`` and ``label`` of labelled documents outside the held-out fold.

    Of more than ``SAMPLE`` labelled ids those with the lowest hashes are taken, each with one text:
    of several that with the least hash. So the rows are about ``SAMPLE`` at most, however often an
    id is repeated. Rows without an id or a label of 0 or 1 train nothing; of several labels of one
    id the greatest counts.
    """
    own = _own(labels, label, folds, held_out)
    share = min(1.0, SAMPLE / max(1, own.count()))
    own = stored(own.filter(F.pmod(F.xxhash64("doc_id"), F.lit(_RANGE)) < int(share * _RANGE)), "labelled")
    # Bounded by SAMPLE rows of a few numbers, so fit for every task.
    digest = F.xxhash64("text").alias("digest")
    texts = docs.select("doc_id", "text", digest)
    chosen = texts.select("doc_id", "digest").join(F.broadcast(own), "doc_id")
    chosen = chosen.groupBy("doc_id").agg(F.min("digest").alias("digest"), F.max("label").alias("label"))
    rows = texts.join(F.broadcast(stored(chosen, "chosen")), ["doc_id", "digest"])
    # Rows left of one id hold one text.
    return rows.groupBy("doc_id").agg(F.first("text").alias("text"), F.first("label").alias("label"))
