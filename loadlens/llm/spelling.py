"""Grouping of spelling variants by a bit-sliced position index.

Words are counted natively over all texts. Of the ``LEAST_CHARS`` code points or more of two words
that differ by one inserted, deleted or replaced code point, half of the shorter word is shared at
the front or at the back; so each word is put under its front and its back half, once as the shorter
(or equally long) and once as the longer word. Under a half, the index holds one bitset over the
words for each position and letter. A query word runs through it letter by letter and keeps, for all
words of the index at the same time, the set that matches without error and the sets that match with
one error: a replaced letter (same position), a letter more in the other word (position shifted
forward) and a letter less (shifted back). Words in a bitset are ordered by count, so the lowest bit
is the best form. A pair that shares both halves counts at the front only.

A half with more than ``INDEXED`` words is indexed in blocks of about so many, and its words query
every block. All words are indexed and all are queries; the result is exact.

A null or empty text has no words; a null id is written as an empty text where a run is hashed with
it. Repeated rows count as often as they are there. An empty table gives an empty result. A very
long text is read whole by Spark's own functions. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadlens.llm.common import stored

#: Fixed values of the task: what a word is, which runs lose a letter, which words and forms count.
RUN = "[A-Za-z\\u00C0-\\u00FF]+"
NO_RUN = "[^A-Za-z\\u00C0-\\u00FF]+"
DELETED_OF = 199
LEAST_CHARS = 6
LEAST_COUNT = 5
TIMES = 5

_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Words of a half in one index.
INDEXED = 16_384
#: 64-bit numbers of one set of all queries looked at together.
CHUNK = 1 << 17
_NONE = np.iinfo(np.int64).max


def vocabulary(docs: DataFrame) -> DataFrame:
    """``word`` and ``n`` of all words that count."""
    text = F.translate("text", _CAPITALS, _CAPITALS.lower())
    # A shorter run cannot give a word: it only loses letters.
    runs = docs.select("doc_id", F.explode(F.split(text, NO_RUN)).alias("run")).filter(F.length("run") >= LEAST_CHARS)
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    runs = runs.select("run", h.alias("h"))
    at = F.pmod(F.col("h"), F.length("run").cast("long")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % DELETED_OF == 0, shorter).otherwise(F.col("run"))
    words = runs.select(word.alias("word")).filter(F.length("word") >= LEAST_CHARS)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _halves() -> Column:
    """The halves a word is put under: length of the shorter word, side (0 front, 1 back) and letters."""
    size = F.length("word")
    made = []
    for least in (size, size - 1):
        half = F.floor(least / 2).cast("int")
        for side, letters in ((0, F.substring("word", F.lit(1), half)), (1, F.right(F.col("word"), half))):
            made.append(F.when(least >= LEAST_CHARS, F.struct(least.alias("least"), F.lit(side).alias("side"), letters.alias("half"))))
    return F.filter(F.array(*made), lambda x: x.isNotNull())


def _dealt(words: DataFrame) -> DataFrame:
    """Rows by half and block: the block's indexed words first, by count, then words that only query it."""
    keys = ["least", "side", "half"]
    under = stored(words.select("word", "n", F.explode(_halves()).alias("key")).select("key.*", "word", "n"), "halves")
    sizes = under.groupBy(*keys).agg(F.count("*").alias("met")).filter("met > 1")
    under = under.join(sizes, keys).withColumn("blocks", F.ceil(F.col("met") / INDEXED).cast("int")).drop("met")
    own = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    blocks = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    dealt = under.withColumn("own", own).select(*keys, "word", "n", "own", blocks)
    # In its own block a word is indexed and queries too.
    dealt = dealt.select(*keys, "block", (F.col("own") != F.col("block")).alias("guest"), "n", "word")
    order = [*keys, "block", "guest", F.col("n").desc(), "word"]
    return dealt.repartition(*keys, "block").sortWithinPartitions(*order)


class Index:
    """Bitsets over words, given by descending count: one for each position and letter, and for each length."""

    def __init__(self, words: list[str]):
        self.size = len(words)
        self.width = -(-self.size // 64)
        lengths = np.array([len(w) for w in words])
        self.longest = int(lengths.max())
        codes = np.zeros((self.size, self.longest), np.uint16)
        for i, w in enumerate(words):
            codes[i, : len(w)] = np.frombuffer(w.encode("utf-16-le"), np.uint16)
        letters, codes = np.unique(codes, return_inverse=True)
        codes = codes.reshape(self.size, self.longest)
        self.letters = letters
        #: One more letter, in no word of the index, stands for all others; position -1 and those past the end are empty.
        self.sets = np.zeros((self.longest + 2, len(letters) + 1, self.width), np.uint64)
        for p in range(self.longest):
            for c in np.unique(codes[:, p]):
                if letters[c]:
                    self.sets[p, c] = self._bits(codes[:, p] == c)
        self.lengths = {int(n): self._bits(lengths == n) for n in np.unique(lengths)}

    def _bits(self, chosen: np.ndarray) -> np.ndarray:
        packed = np.zeros(self.width * 8, np.uint8)
        bits = np.packbits(chosen, bitorder="little")
        packed[: len(bits)] = bits
        return packed.view(np.uint64)

    def _of(self, length: int) -> np.ndarray:
        return self.lengths.get(length, np.zeros(self.width, np.uint64))

    def near(self, words: list[str], half: int) -> np.ndarray:
        """A bitset for each word: those of the index one edit away that do not share its first ``half`` letters.

        All ``words`` have one length. With ``half`` 0 all words one edit away are in the set.
        """
        m = len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-16-le"), np.uint16).reshape(len(words), m)
        at = np.minimum(np.searchsorted(self.letters, codes), len(self.letters) - 1)
        at = np.where(self.letters[at] == codes, at, len(self.letters))
        empty = np.zeros((len(words), self.width), np.uint64)
        exact = ~empty
        replaced, more, less = empty, empty, empty
        shared = empty
        for i in range(m):
            # Sets of words with this letter here, one place on, one place back.
            here, on, back = (self.sets[p if 0 <= p < self.longest else -1][at[:, i]] for p in (i, i + 1, i - 1))
            replaced = replaced & here | exact & ~here
            more = (more | exact) & on
            less = less & back | exact
            exact = exact & here
            if i + 1 == half:
                shared = exact
        found = replaced & self._of(m) | (more | exact) & self._of(m + 1) | less & self._of(m - 1)
        return found & ~shared


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``word``, ``n_near``, ``form_n`` and ``form`` of each query in each block where it has near words."""
    key, indexed, counts, index = None, [], [], None
    queries: list[str] = []

    def answered() -> Iterator[pa.RecordBatch]:
        nonlocal queries, index
        if len(indexed) + len(queries) > 1 and indexed:
            index = index or Index(indexed)
            half = key[0] // 2 if key[1] else 0
            # A word as long as the shorter, or one longer.
            for m in (key[0], key[0] + 1):
                alike = [w for w in queries if len(w) == m]
                step = max(1, CHUNK // index.width)
                for i in range(0, len(alike), step):
                    yield from _best(index, alike[i : i + step], half)
        queries = []

    def _best(index: Index, words: list[str], half: int) -> Iterator[pa.RecordBatch]:
        sets = index.near(words, half)
        if len(words[0]) == key[0] + 1:
            # Pairs of two longer words belong to the next length.
            sets &= index._of(key[0])
        n = np.bitwise_count(sets).sum(axis=1, dtype=np.int64)
        hit = np.flatnonzero(n)
        if len(hit):
            first = (sets[hit] != 0).argmax(axis=1)
            bits = sets[hit, first]
            lowest = 64 * first + np.bitwise_count((bits & (~bits + np.uint64(1))) - np.uint64(1)).astype(np.int64)
            columns = [[words[i] for i in hit], n[hit], [counts[i] for i in lowest], [indexed[i] for i in lowest]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["word", "n_near", "form_n", "form"])

    for batch in batches:
        columns = batch.to_pydict()
        for least, side, half, block, guest, n, word in zip(*columns.values(), strict=True):
            if (least, side, half, block) != key:
                yield from answered()
                key, indexed, counts, index = (least, side, half, block), [], [], None
            if not guest:
                indexed.append(word)
                counts.append(n)
            queries.append(word)
            # The indexed words are all there once the first guest comes.
            if guest and len(queries) >= INDEXED:
                yield from answered()
    if key is not None:
        yield from answered()


def variants(words: DataFrame) -> DataFrame:
    """``word``, ``n``, ``n_near`` (words one edit away) and the near word of largest count with its count."""
    schema = "word string, n_near bigint, form_n bigint, form string"
    parts = _dealt(words).mapInArrow(_searched, schema)
    best = F.max(F.struct("form_n", F.col("form"))).alias("best")
    # Of forms with one count the smallest is wanted, so blocks keep the smallest of the largest count.
    most = parts.groupBy("word", "form_n").agg(F.sum("n_near").alias("n_near"), F.min("form").alias("form"))
    most = most.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return words.join(most.select("word", "n_near", "best.*"), "word", "left").fillna({"n_near": 0})


def rooted(words: DataFrame) -> DataFrame:
    """``words`` with ``root``: from ``word`` along ``form`` to the last.

    Each turn doubles the way that is known. Counts grow ``TIMES``-fold on the way, so it is short.
    """
    ways = stored(words.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "ways")
    while True:
        further = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = ways.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), "further")
        step = stored(step, "ways")
        ways = step.select("word", "root")
        if not step.filter(F.col("further").isNotNull()).limit(1).count():
            break
    return words.join(ways, "word", "left").withColumn("root", F.coalesce("root", "word"))


def grouped(docs: DataFrame) -> DataFrame:
    """Words of all documents with their forms and roots, in the columns of the contract."""
    words = stored(vocabulary(docs), "words")
    found = variants(words)
    formed = F.col("form_n") >= TIMES * F.col("n")
    form, form_n = F.when(formed, F.col("form")), F.when(formed, F.col("form_n"))
    found = stored(found.select("word", "n", "n_near", form.alias("form"), form_n.alias("form_n")), "forms")
    return rooted(found).select("word", "form", "root", "n", "n_near", "form_n")
