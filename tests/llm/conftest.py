"""Small tables with every odd case: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from loadlens.llm.common import shipped

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in "ba ce di fo gu ha ke li".split() for b in "ran sol tem vik pon dar mes".split()]


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + draw.choice(WORDS) for _ in range(n))


def rows() -> list[tuple]:
    base = prose(1, 120)
    words = base.split()
    near = " ".join(words[:60] + ["changed"] + words[61:])
    long = prose(2, 30_000)
    texts = [(i, prose(100 + i, 70)) for i in range(20)]
    texts += [(20, base), (21, base), (22, near), (23, base.upper()), (30, None), (31, ""), (32, " \n\t "), (33, "two words")]
    texts += [(34, long), (35, long), (None, base), (None, None), (36, "two words"), (37, "a b\na b\na b"), (20, base), (38, prose(3, 60) + " é…﻿𝟗")]
    return [(i, t, ("en", "fr", None, "xx")[k % 4], "s", None if t is None else len(t)) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def llm(spark):
    return shipped(spark)


@pytest.fixture(scope="module")
def docs(llm):
    """All odd cases, with columns whose names the operators use themselves."""
    made = llm.createDataFrame(rows(), SCHEMA).repartition(3)
    for name in ("shard", "slot", "score", "class", "label", "size", "_gone", "bucket"):
        made = made.withColumn(name, F.lit("mine"))
    return made


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)
