"""Toxicity by weak supervision.

Voters look for words of a lexicon or for patterns of writing. The lexicon is a fixed list of insults
and, for other languages, word beginnings that labelled toxic documents share and clean ones lack.
Its words are dealt to several voters by hash, so the voters err apart. A generative label model
takes how often voters fire, alone and in pairs, from all documents: the covariance of two voters
that agree only because of the class is the product of their strengths, so the strengths follow from
all pairs, and pairs that agree more than that count as correlated and share one say. Its posteriors
label a bounded sample, and a linear classifier on hashed word beginnings learns from them. Two
numbers that turn its sums into scores come from labelled rows.

A text without words scores like any text in which no feature is known. Without labelled rows of
both kinds the fixed list alone votes. Null ids, repeated rows and further columns do not matter.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadlens.llm.common import fold_of, in_fold, stored
from loadlens.llm.labelled import training_rows

FOLDS, HELD_OUT = 3, 1
TOXIC = 0.7
#: Insults.
INSULTS = "idiot moron stupid dumb loser clown scum trash worthless pathetic disgusting ugly jerk fool bastard"
#: Words that a task remembers at once; beyond it it begins anew.
REMEMBERED = 1 << 18
#: Voters that share the words of the lexicon.
DEALT = 6
#: Word beginnings in the lexicon at most, the strongest first.
LEXICON = 4096
#: A beginning is taken if this many toxic documents have it, and it is this many times as frequent in them as in others.
LEAST, RATIO = 5, 12.0
SIZES = (4, 5, 6)
FEATURES = 1 << 18
#: Standard errors by which a feature leans to a class before it counts, and the pull of weights to 0.
LEAN = 5.0
#: Parts that a chance is counted in when chances are added up over the cluster.
_SCALE = 1 << 30
DECAY = 1e-3
#: One labelled row of this many sets how sums become scores instead of the weights.
CALIBRATION = 5
#: Covariance beyond the model, as a share of the deviations, that marks two voters as correlated.
TIE = 0.2

_WORD = re.compile(r"[^\W\d_]+")
_SHOUT = re.compile(r"[A-Z]{4,}[!?]")
_YOU = re.compile(r"\b(?:you|toi|du|tú) (?:are|es|bist|eres)\b")
PATTERNS = ("shouting", "signs", "address", "repeats")
VOTERS = DEALT + len(PATTERNS)


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def beginnings(words: set[str]) -> set[str]:
    """Whole words and their first letters, the whole ones marked."""
    out = {f"={w}" for w in words}
    for size in SIZES:
        out.update([w[:size] for w in words if len(w) >= size])
    return out


class Remembered(dict):
    """What a function gives for each word, kept for the words met last, as few words make up most of a text."""

    def __init__(self, of: Callable) -> None:
        self.of = of

    def __missing__(self, word: str):
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = got = self.of(word)
        return got

    def __reduce__(self):
        return Remembered, (self.of,)


def word_votes(lexicon: frozenset[str]) -> Remembered:
    """The voter that a word of the lexicon makes fire, as a bit; 0 for other words."""

    def of(w: str) -> int:
        hit = f"={w}" in lexicon or any(w[:size] in lexicon for size in SIZES)
        return 1 << zlib.crc32(w.encode()) % DEALT if hit else 0

    return Remembered(of)


def votes(text: str, voted: Remembered) -> int:
    """The voters that fire, as bits, by the votes of words."""
    out = 0
    for w in words_of(text):
        out |= voted[w]
    n = len(text) + 1
    shown = (
        len(_SHOUT.findall(text)) * 200 > n,
        sum(map(text.count, "!?")) * 50 > n,
        bool(_YOU.search(text.lower())),
        "!!" in text,
    )
    for k, fires in enumerate(shown):
        out |= fires << (DEALT + k)
    return out


def lexicon_of(rows: DataFrame) -> frozenset[str]:
    """The fixed words and the beginnings that tell toxic from clean labelled rows."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [beginnings(words_of(t)) if t else () for t in batch.column(0).to_pylist()]
            labels = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([b for own in found for b in own], pa.string()),
                    pa.array([y for own, y in zip(found, labels, strict=True) for _ in own], pa.int32()),
                ],
                names=["beginning", "label"],
            )

    total = rows.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count("*")).first()
    toxic, clean = total[0], total[1] - total[0]
    fixed = frozenset(f"={w}" for w in INSULTS.split())
    if not toxic or not clean:
        return fixed
    counts = rows.select("text", "label").mapInArrow(spread, "beginning string, label int")
    counts = counts.groupBy("beginning").agg(F.sum("label").alias("t"), F.count("*").alias("n"))
    ratio = (F.col("t") / toxic) / ((F.col("n") - F.col("t") + 0.5) / clean)
    strong = counts.withColumn("ratio", ratio).filter((F.col("t") >= LEAST) & (F.col("ratio") >= RATIO))
    strong = strong.orderBy(F.desc("ratio"), F.desc("t"), "beginning").limit(LEXICON)
    return fixed | {r[0] for r in strong.select("beginning").collect()}


@dataclass
class LabelModel:
    """How often each voter fires in toxic and in clean documents, and the say of each."""

    toxic: np.ndarray
    clean: np.ndarray
    say: np.ndarray
    prior: float

    def posterior(self, fired: np.ndarray) -> np.ndarray:
        """Chance of toxicity by voters fired (rows of 0 and 1)."""
        yes = np.log(self.toxic / self.clean)
        no = np.log((1 - self.toxic) / (1 - self.clean))
        odds = np.log(self.prior / (1 - self.prior)) + (fired * yes + (1 - fired) * no) @ self.say
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def label_model(alone: np.ndarray, pairs: np.ndarray, n: float, prior: float) -> LabelModel:
    """The model behind the counts: voters fired, pairs of voters fired, documents, and the share of toxic ones."""
    n = max(n, 1.0)
    rate = (alone + 0.5) / (n + 1)
    covariance = pairs / n - np.outer(alone, alone) / n**2
    deviation = np.sqrt(rate * (1 - rate))
    # Patterns look at the same signs, so their strength comes from the lexicon's voters alone.
    known = np.eye(len(rate), dtype=bool)
    known[DEALT:, DEALT:] = True
    tied = known
    strength = np.zeros(len(rate))
    for _ in range(3):
        # Alternating least squares of covariance = strength x strength over pairs that are not tied.
        free = ~tied
        strength = np.sqrt(np.maximum(np.where(free, covariance, 0).max(axis=1), 0)) + 1e-6
        for _ in range(200):
            for i in range(len(rate)):
                weight = free[i] / deviation**2
                bottom = (weight * strength**2).sum()
                if bottom > 0:
                    strength[i] = max((weight * covariance[i] * strength).sum() / bottom, 0)
        beyond = np.abs(covariance - np.outer(strength, strength)) / np.outer(deviation, deviation)
        new = known | (beyond > TIE)
        # Keep at least three untied partners: without them a strength has no source.
        few = (~new).sum(axis=1) < 3
        new[few] = known[few]
        new &= new.T
        if (new == tied).all():
            break
        tied = new
    # strength = (chance if toxic - chance if clean) * sqrt(prior * (1 - prior))
    gap = strength / np.sqrt(prior * (1 - prior))
    toxic = np.clip(rate + gap * (1 - prior), 1e-4, 1 - 1e-4)
    clean = np.clip(rate - gap * prior, 1e-4, 1 - 1e-4)
    silent = alone < 1
    toxic[silent] = clean[silent] = 0.5
    return LabelModel(toxic, clean, 1.0 / tied.sum(axis=1), prior)


def _fired(bits: np.ndarray) -> np.ndarray:
    return (bits[:, None] >> np.arange(VOTERS) & 1).astype(float)


def vote_counts(docs: DataFrame, lexicon: frozenset[str]) -> tuple[np.ndarray, np.ndarray, float]:
    """Over all documents: how often each voter and each pair of voters fires, and the documents."""

    voted = word_votes(lexicon)

    def vote(texts: pa.Array) -> pa.Array:
        return pa.array([votes(t or "", voted) for t in texts.to_pylist()], pa.int32())

    # One row for each set of voters that fires, of 2 ** VOTERS at most.
    rows = docs.select(F.arrow_udf(vote, "int")("text").alias("bits")).groupBy("bits").agg(F.count("*").alias("n"))
    sums = [F.sum(F.when(F.col("bits").bitwiseAND((1 << i) | (1 << j)) == (1 << i) | (1 << j), F.col("n")).otherwise(0)).alias(f"p{i}_{j}")
            for i in range(VOTERS) for j in range(i, VOTERS)]
    got = rows.agg(F.sum("n").alias("n"), *sums).first()
    pairs = np.zeros((VOTERS, VOTERS))
    for i in range(VOTERS):
        for j in range(i, VOTERS):
            pairs[i, j] = pairs[j, i] = float(got[f"p{i}_{j}"] or 0)
    return np.diag(pairs).copy(), pairs, float(got["n"] or 0)


def places_of(word: str) -> list[int]:
    """Places of the features of a word."""
    return [zlib.crc32(b.encode()) & (FEATURES - 1) for b in beginnings({word})]


def features(text: str, places: Remembered) -> np.ndarray:
    """Sorted places of the features of a text, by the places of words."""
    return np.array(sorted({p for w in words_of(text) for p in places[w]}), np.int32)


@dataclass
class Linear:
    """Weights of features, the weight of none, and how sums become scores."""

    weights: np.ndarray
    bias: float
    scale: float = 1.0
    shift: float = 0.0

    def sum(self, places: np.ndarray) -> float:
        return float(self.weights[places].sum() + self.bias)

    def score(self, total: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.scale * total + self.shift, -30, 30))))


def _told(rows: DataFrame, posterior: dict[int, float], share: float) -> np.ndarray:
    """``telling`` counted on the cluster, from ``bits`` and ``places`` of the rows."""
    # Whole numbers, so that the sum does not depend on the order of rows.
    say = F.create_map(*[F.lit(x) for k, p in posterior.items() for x in (k, round(p * _SCALE))])
    sums = rows.select(F.element_at(say, F.col("bits")).alias("p"), F.explode("places").alias("place"))
    sums = sums.groupBy("place").agg(F.count("*").alias("n"), F.sum("p").alias("p"))
    n = F.col("n")
    lean = (F.col("p") / _SCALE - n * share) / F.sqrt(n * (share * (1 - share)))
    places = sums.filter((F.abs(lean) >= LEAN) & (n >= LEAST)).select("place").toArrow()  # FEATURES at most
    told = np.zeros(FEATURES, bool)
    told[places.column("place").to_numpy()] = True
    return told


def telling(rows: list[np.ndarray], target: np.ndarray) -> np.ndarray:
    """Whether each feature leans to one class by more than chance: its mean posterior, in standard errors."""
    flat = np.concatenate(rows)
    n = np.bincount(flat, minlength=FEATURES)
    toxic = np.bincount(flat, np.repeat(target, [len(r) for r in rows]), FEATURES)
    share = float(np.clip(target.mean(), 1e-6, 1 - 1e-6))
    lean = (toxic - n * share) / np.sqrt(np.maximum(n, 1) * share * (1 - share))
    return (np.abs(lean) >= LEAN) & (n >= LEAST)


def train(rows: list[np.ndarray], target: np.ndarray, *, epochs: int = 25, rate: float = 0.3) -> Linear:
    """Logistic regression on soft labels with AdaGrad, over telling features; features come as places."""
    told = telling(rows, target)
    rows = [r[told[r]] for r in rows]
    weights, squares = np.zeros(FEATURES), np.full(FEATURES, 1e-2)
    share = float(np.clip(target.mean(), 1e-3, 1 - 1e-3))
    bias, bias_square = float(np.log(share / (1 - share))), 1e-2
    rng = np.random.default_rng(6)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            own = rows[i]
            error = 1 / (1 + np.exp(-np.clip(weights[own].sum() + bias, -30, 30))) - target[i]
            slope = error + DECAY * weights[own]
            squares[own] += slope * slope
            weights[own] -= rate * slope / np.sqrt(squares[own])
            bias_square += error * error
            bias -= rate * error / np.sqrt(bias_square)
    return Linear(weights, bias)


def _calibrated(model: Linear, totals: np.ndarray, y: np.ndarray) -> None:
    """Scale and shift of least loss on labelled rows, by Newton steps with a slight pull to the start."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * totals + b, -30, 30)))
        w = p * (1 - p) + 1e-6
        slope = np.array([((p - y) * totals).sum() + 1e-2 * (a - 1), (p - y).sum() + 1e-2 * b])
        curve = np.array([[(w * totals**2).sum() + 1e-2, (w * totals).sum()], [(w * totals).sum(), w.sum() + 1e-2]])
        step = np.linalg.solve(curve, slope)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    if a > 0:
        model.scale, model.shift = float(a), float(b)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Linear:
    """The classifier of all documents and the labelled ones outside the held-out fold."""
    rows = stored(training_rows(docs, labels, label, FOLDS, HELD_OUT), "toxic-rows")
    lexicon = lexicon_of(rows)
    alone, pairs, n = vote_counts(docs, lexicon)

    voted, known = word_votes(lexicon), Remembered(places_of)

    def read(texts: pa.Array) -> pa.Array:
        return pa.array([{"bits": votes(t or "", voted), "places": features(t or "", known)} for t in texts.to_pylist()],
                        pa.struct([("bits", pa.int32()), ("places", pa.list_(pa.int32()))]))

    made = F.arrow_udf(read, "struct<bits:int,places:array<int>>")("text").alias("f")
    read_rows = stored(rows.select("doc_id", "label", made).select("doc_id", "label", "f.*"), "toxic-features")
    got = read_rows.select("doc_id", "label", "bits").toArrow()  # bounded by the sample
    order = np.argsort(got.column("doc_id").to_numpy(), kind="stable")
    keys, bits = (got.column(c).to_numpy()[order] for c in ("doc_id", "bits"))
    y = got.column("label").to_numpy().astype(float)[order]
    share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.1
    model = label_model(alone, pairs, n, share)
    if not len(y):
        return Linear(np.zeros(FEATURES), float(np.log(share / (1 - share))))
    target = model.posterior(_fired(bits.astype(np.int64)))
    apart = np.array([in_fold(f"c{k}", CALIBRATION) == 0 for k in keys])
    if not 0 < y[apart].sum() < apart.sum():
        apart[:] = False
    # Of the features only those that tell anything leave the cluster.
    taught = read_rows
    if apart.any():
        taught = taught.filter(F.pmod(F.crc32(F.concat(F.lit("c"), F.col("doc_id")).cast("binary")), F.lit(CALIBRATION)) != 0)
    posterior = {int(b): float(p) for b, p in zip(bits, target, strict=True)}
    told = _told(taught, posterior, float(np.clip(target[~apart].mean(), 1e-6, 1 - 1e-6)))

    def narrow(places: pa.Array) -> pa.Array:
        return pa.array([[p for p in own if told[p]] for own in places.to_pylist()], pa.list_(pa.int32()))

    kept = read_rows.select("doc_id", F.arrow_udf(narrow, "array<int>")("places").alias("places")).toArrow()
    places = kept.column("places").combine_chunks()
    own = [places[int(i)].values.to_numpy() for i in np.argsort(kept.column("doc_id").to_numpy(), kind="stable")]
    linear = train([p for p, out in zip(own, apart, strict=True) if not out], target[~apart])
    judged = apart if apart.any() else ~apart
    _calibrated(linear, np.array([linear.sum(own[i]) for i in np.flatnonzero(judged)]), y[judged])
    return linear


def score_of(model: Linear, text: Column | str) -> Column:
    """The score of a text column; features without weight add nothing, so most words have none to look at."""
    weighty = model.weights != 0
    known = Remembered(lambda word: [p for p in places_of(word) if weighty[p]])

    def score(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(model.sum(features(t or "", known))) for t in texts.to_pylist()], pa.float64())

    return F.arrow_udf(score, "double")(text)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents, in the columns of the contract."""
    rows = docs.select("doc_id", score_of(fit(docs, labels), "text").alias("score"))
    held = F.coalesce(fold_of("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))
