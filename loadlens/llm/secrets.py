"""Secret scan: wide candidates, and a random forest that takes out the false ones.

A candidate is a run of 16 or more characters that keys are written in, or a value of 8 or more
characters assigned to a secret name. The forest sees its length and signs, how usual its letter pairs
are (counted over all documents), how much of it the most frequent words of all documents cover,
whether it looks like a path, and the words next to it. It is trained from labelled findings whose
harmless words are drawn from the same dictionary.

A finding is reported by place and SHA-256, never in clear. Positions are code points, ends are
exclusive. A null or empty text has no findings; an empty corpus makes all letter pairs alike. Each
row is read by itself, so null and repeated ids and further columns do not matter.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadlens.llm.common import stored
from loadlens.llm.secret_findings import HARMLESS_NAMES, SECRET_NAMES, WORDS, labelled_findings
from loadlens.llm.tokens import LOWER, as_bytes

TREES, DEPTH, LEAST_LEAF = 40, 9, 3
ACCEPTED = 0.5
#: Most frequent words of the corpus that make the dictionary, and how often the rarest occurs at least.
DICTIONARY, LEAST = 20_000, 5
#: Letters of the words in the dictionary.
SHORTEST, LONGEST = 4, 20
_CANDIDATE = re.compile(r"[A-Za-z0-9_+/=.-]{16,}")
_ASSIGNED = re.compile(
    r"(?:%s)\w{0,20}[\"']?\s{0,3}[=:]\s{0,3}[\"']?([A-Za-z0-9_+/=.!@#$%%^&*?~<>-]{8,})" % "|".join(sorted(SECRET_NAMES, key=len, reverse=True)),
    re.IGNORECASE,
)
_NEAR = re.compile(r"[A-Za-z_0-9]+")
_LETTERS = re.compile(r"[a-z]{%d,}" % SHORTEST)
_FIXED = frozenset(w for w in (*WORDS, *SECRET_NAMES) if len(w) >= SHORTEST)
_RUN = re.compile(r"[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]")
_NAMES = frozenset(SECRET_NAMES)
_HARMLESS = frozenset(HARMLESS_NAMES)
#: Characters before and after a candidate that count as its surroundings.
NEAR = 40
FEATURES = (
    "length", "digits", "capitals", "signs", "entropy", "distinct", "runs", "hex", "dashes", "pairs", "unusual pairs", "covered",
    "slashes", "path before", "assigned", "quoted", "secret name", "harmless name", "words around",
)


def letter_pairs(docs: DataFrame) -> np.ndarray:
    """Logarithm of the share of each letter after each letter, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(27 * 27, np.int64)
        for batch in batches:
            for text in as_bytes(batch.column(0).to_pylist()):
                raw = np.frombuffer(text, np.uint8)
                for at in range(0, len(raw), 1 << 20):
                    part = LOWER[raw[at : at + (1 << 20) + 1]].astype(np.int32) - 96
                    part[(part < 1) | (part > 26)] = 0
                    total += np.bincount(part[:-1] * 27 + part[1:], minlength=27 * 27)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(27 * 27)), pa.array(total)], names=["pair", "n"])

    rows = docs.select(F.col("text").cast("binary")).mapInArrow(count, "pair bigint, n bigint")
    out = np.ones((27, 27))
    for pair, n in rows.groupBy("pair").agg(F.sum("n")).collect():  # 729 rows
        out[pair // 27, pair % 27] += n
    letters = out[1:, 1:]
    return np.log(letters / letters.sum(axis=1, keepdims=True))


def corpus_words(docs: DataFrame) -> list[str]:
    """The most frequent words of plain letters over all documents, ``DICTIONARY`` of them at most, in order."""
    words = docs.select(F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")).alias("word"))
    words = words.filter(F.col("word").rlike(f"^[a-z]{{{SHORTEST},{LONGEST}}}$")).groupBy("word").agg(F.count("*").alias("n"))
    top = words.filter(F.col("n") >= LEAST).orderBy(F.desc("n"), "word").limit(DICTIONARY)
    return sorted(r[0] for r in top.select("word").collect())


def covered(text: str, words: frozenset[str]) -> int:
    """Characters of a lower-cased text that words cover, from the left, the longest first."""
    out = 0
    for run in _LETTERS.findall(text):
        at = 0
        while at <= len(run) - SHORTEST:
            size = next((k for k in range(min(LONGEST, len(run) - at), SHORTEST - 1, -1) if run[at : at + k] in words), 0)
            out += size
            at += size or 1
    return out


def seen(text: str, start: int, end: int, pairs: np.ndarray, words: frozenset[str] = _FIXED) -> list[float]:
    """The features of one candidate, as named in ``FEATURES``."""
    own = text[start:end]
    n = len(own)
    low = own.lower()
    counts = Counter(own)
    codes = [ord(c) - 97 for c in low]
    steps = [pairs[a, b] for a, b in zip(codes, codes[1:], strict=False) if 0 <= a < 26 and 0 <= b < 26]
    before = text[max(0, start - NEAR) : start]
    after = text[end : end + NEAR]
    near = [w.lower() for w in _NEAR.findall(before)[-2:]]
    around = [*_NEAR.findall(before), *_NEAR.findall(after)]
    lead = before.rstrip("\"' ")
    return [
        n,
        sum(c.isdigit() for c in own) / n,
        sum(c.isupper() for c in own) / n,
        sum(not c.isalnum() for c in own) / n,
        -sum(k / n * math.log2(k / n) for k in counts.values()),
        len(counts) / n,
        len(_RUN.findall(own)) / n,
        float(all(c in "0123456789abcdef-" for c in low)),
        low.count("-") / n,
        float(np.mean(steps)) if steps else -6.0,
        sum(s < -4.5 for s in steps) / n,
        covered(low, words) / n,
        own.count("/") / n,
        float(before.endswith(("/", "://", "\\", "."))),
        float(lead.endswith(("=", ":"))),
        float(before.endswith(('"', "'"))),
        float(any(name in w for w in near for name in _NAMES)),
        float(any(w in _HARMLESS for w in near)),
        sum(w.isalpha() for w in around) / max(1, len(around)),
    ]


class Forest:
    """Trees on drawn rows, each split the best of some drawn features; a leaf holds its share of label 1."""

    def __init__(self, x: np.ndarray, y: np.ndarray, *, trees: int = TREES, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.trees = []
        for _ in range(trees):
            rows = rng.integers(0, len(x), len(x))
            tree: list[tuple] = []
            self._grow(tree, x[rows], y[rows], 0, rng)
            self.trees.append(tuple(np.array(part) for part in zip(*tree, strict=True)))

    def _grow(self, tree: list, x: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator) -> int:
        at = len(tree)
        share = float(y.mean()) if len(y) else 0.0
        tree.append((-1, 0.0, 0, 0, share))
        if depth == DEPTH or share in (0.0, 1.0) or len(y) < 2 * LEAST_LEAF:
            return at
        best = (2 * share * (1 - share) * len(y) - 1e-9, None, None)
        for f in rng.choice(x.shape[1], max(2, int(np.sqrt(x.shape[1]))), replace=False):
            order = np.argsort(x[:, f], kind="stable")
            v, left = x[order, f], np.cumsum(y[order])
            n = np.arange(1, len(y) + 1)
            real = np.flatnonzero((v[1:] > v[:-1]) & (n[:-1] >= LEAST_LEAF) & (n[:-1] <= len(y) - LEAST_LEAF))
            if len(real):
                a, b = left[real] / n[real], (left[-1] - left[real]) / (len(y) - n[real])
                impure = 2 * a * (1 - a) * n[real] + 2 * b * (1 - b) * (len(y) - n[real])
                k = int(np.argmin(impure))
                if impure[k] < best[0]:
                    best = (float(impure[k]), int(f), float((v[real[k]] + v[real[k] + 1]) / 2))
        if best[1] is not None:
            below = x[:, best[1]] <= best[2]
            low = self._grow(tree, x[below], y[below], depth + 1, rng)
            high = self._grow(tree, x[~below], y[~below], depth + 1, rng)
            tree[at] = (best[1], best[2], low, high, share)
        return at

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, limit, low, high, share in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(DEPTH):
                f = feature[at]
                below = x[rows, f] <= limit[at]
                at = np.where(f < 0, at, np.where(below, low[at], high[at]))
            total += share[at]
        return total / len(self.trees)


def trained(pairs: np.ndarray, findings: list[tuple[str, int, int, int]], words: frozenset[str] = _FIXED) -> Forest:
    x = np.array([seen(text, a, b, pairs, words) for text, a, b, _ in findings], float)
    return Forest(x, np.array([y for *_, y in findings], float))


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs that may be secrets, without dots and equals signs that only end a sentence or begin a value.

    A value of a secret name that holds no such run comes too, without a dot at its end; where name
    and value are one run, the value alone.
    """
    out = []
    for m in _CANDIDATE.finditer(text):
        start, end = m.span()
        while start < end and text[start] in "=.":
            start += 1
        while end > start and text[end - 1] == ".":
            end -= 1
        # name=value without spaces: the value is the candidate.
        sign = text.find("=", start, end)
        if sign > start and end - sign > 16:
            start = sign + 1
        if end - start >= 16:
            out.append((start, end))
    short, k = [], 0
    for m in _ASSIGNED.finditer(text):
        start, end = m.span(1)
        while end > start and text[end - 1] == ".":
            end -= 1
        while k < len(out) and out[k][1] <= start:
            k += 1
        if end - start < 8:
            continue
        if k < len(out) and out[k][0] < start:  # name and value are one run
            out[k] = (start, end)
        elif k == len(out) or out[k][0] >= end:
            short.append((start, end))
    return sorted(out + short)


def found(docs: DataFrame, findings: list[tuple[str, int, int, int]] | None = None) -> DataFrame:
    """All findings of all documents that the forest takes for secrets, a row each."""
    pairs = letter_pairs(docs)
    common = corpus_words(docs)
    words = _FIXED | frozenset(common)
    forest = trained(pairs, findings or labelled_findings(words=common or WORDS), words)

    def scan(texts: pa.Array) -> pa.Array:
        rows = []
        for text in texts.to_pylist():
            places = candidates(text) if text else []
            scores = forest.scores(np.array([seen(text, a, b, pairs, words) for a, b in places], float)) if places else []
            rows.append(
                [
                    {"start": a, "end": b, "score": float(s), "sha256": hashlib.sha256(text[a:b].encode()).hexdigest()}
                    for (a, b), s in zip(places, scores, strict=True)
                    if s >= ACCEPTED
                ]
            )
        return pa.array(rows, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("sha256", pa.string())])))

    made = F.arrow_udf(scan, "array<struct<start:bigint,end:bigint,score:double,sha256:string>>")("text")
    # Stored first: a filter on the list would have each text scanned twice.
    rows = stored(docs.select("doc_id", made.alias("found")), "secrets").filter(F.size("found") > 0)
    return rows.select("doc_id", F.inline("found"))
