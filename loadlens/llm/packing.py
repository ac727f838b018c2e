"""Packing by powers of two.

The ids of a document, with id 0 as its end, are cut into pieces whose lengths are powers of two: as
many of the longest as fit, then the binary digits of the rest. Each piece is a sequence by itself
in the bucket of its length, so no sequence crosses documents and none is padded.

A null or empty text is the end id alone. Every row is cut by itself: null ids and repeated rows
give pieces like all others, an empty table gives an empty result. Sequence ids are places in the
partitions of the input, which must be a table (files) for them to be the same in a second attempt.

Ids are those of the ``tokenizers`` file. Plain Latin text goes through ``tiktoken`` with the same
vocabulary and pattern, which gives the same ids at four times the speed; all other text, and text
with very long runs, goes through ``tokenizers`` itself.
"""

from __future__ import annotations

import base64
import functools
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONGEST = 1024
END = 0
VOCABULARY = "byte_bpe_50k"
PIECES = "array<struct<start:bigint,length:bigint,ids_crc32:bigint,doc_tokens:bigint,ids:array<int>>>"
_FIELDS = [
    *((name, pa.int64()) for name in ("start", "length", "ids_crc32", "doc_tokens")),
    ("ids", pa.list_(pa.int32())),
]

#: Texts for the fast path: code points that both libraries split alike, no run of 2000 without change of kind.
_OTHER = re.compile(r"[^\x09\x0A\x0D\x20-\x7E¡-¬®-ɏ]|\S{2000}|\s{2000}")


@functools.cache
def _whole(vocabulary: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
    tokenizer.encode_special_tokens = True
    return tokenizer


@functools.cache
def _fast(vocabulary: str):
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(text: str, vocabulary: str = VOCABULARY) -> np.ndarray:
    """The ids of a text, the end id last."""
    if not text:
        ids = []
    elif _OTHER.search(text):
        ids = _whole(vocabulary).encode(text, add_special_tokens=False).ids
    else:
        ids = _fast(vocabulary).encode_ordinary(text)
    return np.array([*ids, END], np.uint32)


def cut(n: int, longest: int = LONGEST) -> list[tuple[int, int]]:
    """Start and length of each piece of ``n`` ids, longest first."""
    pieces = [(i * longest, longest) for i in range(n // longest)]
    at, length = len(pieces) * longest, longest // 2
    while at < n:
        if n - at >= length:
            pieces.append((at, length))
            at += length
        length //= 2
    return pieces


def pieces(
    docs: DataFrame, *, longest: int = LONGEST, with_ids: bool = True, vocabulary: str = VOCABULARY
) -> DataFrame:
    """All pieces of all documents: ``doc_id``, place and ids of the piece, and its sequence."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")

    @F.arrow_udf(PIECES)
    def cut_up(texts: pa.Array) -> pa.Array:
        rows = []
        for value in texts:
            ids = ids_of(value.as_py(), vocabulary)
            rows.append(
                [
                    {"start": s, "length": n, "ids_crc32": zlib.crc32(ids[s : s + n].tobytes()), "doc_tokens": len(ids), "ids": ids[s : s + n].tolist() if with_ids else None}
                    for s, n in cut(len(ids), longest)
                ]
            )
        return pa.array(rows, pa.list_(pa.struct(_FIELDS)))

    # Every text has a piece. The outer form spares a filter on the pieces, for which each text would be cut up twice.
    rows = docs.select("doc_id", cut_up("text").alias("pieces")).select("doc_id", F.inline_outer("pieces"))
    bucket = F.log2("length").cast("int")
    return rows.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        # The bucket is in the upper bits, so the sequences of a bucket have neighbouring ids.
        (F.shiftleft(bucket.cast("long"), 57) + F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        bucket.alias("bucket"), "ids",
    )


def write_buckets(docs: DataFrame, path: str, **options) -> None:
    """Write all pieces by bucket, so that a reader takes batches of one length."""
    pieces(docs, **options).write.partitionBy("bucket").parquet(path)


def packed(docs: DataFrame) -> DataFrame:
    """The pieces of all documents, in the columns of the contract."""
    return pieces(docs.select("doc_id", "text"), with_ids=False).drop("ids", "bucket")
