"""Quality classifier on random-indexing vectors.

Subwords (runs of one kind of byte) are hashed to buckets. Each bucket has a fixed sparse ternary
index vector; its context vector is the sum of the index vectors around all its occurrences in all
documents, added up in whole numbers, so the order of tasks does not matter. A text is pooled into
means and deviations of its subwords' vectors and how alike neighbours are. A network of two layers
is trained on all labelled rows outside the held-out fold; a part of them sets the temperature. More
rows than ``TOGETHER`` are dealt to groups of about that many: each group descends by itself from
the same weights, and the mean of what the groups come to begins the next round.

A text without subwords (null, empty, blank) scores 0. Without labels of both kinds every text
scores the share of label 1, or one half without any. Rows are scored by themselves: null ids,
repeated rows and further columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadlens.llm.common import fold_of, in_fold, stored
from loadlens.llm.labelled import all_training_rows
from loadlens.llm.tokens import RUNS, as_bytes, hashed_words, numbers

BUCKETS = 1 << 14
SIZE = 32
#: Entries of an index vector that are not 0.
NONZERO = 4
REACH = 2
HIDDEN = 32
FOLDS, HELD_OUT = 4, 2
ACCEPTED = 0.7
#: One labelled row of this many sets the temperature instead of the weights.
CALIBRATION = 5
#: Labelled rows that one task trains on, about.
TOGETHER = 20_000
EPOCHS = 60
#: Rounds that the epochs are parted into where several groups train.
ROUNDS = 6
TEMPERATURES = np.geomspace(0.25, 8, 61)
#: Parts that sums over groups are counted in, so that they do not depend on the order of groups.
_SCALE = 1 << 40
_VALUE_SCALE = 1 << 20


def index_vectors() -> np.ndarray:
    """The fixed vectors of all buckets; one more, all zero, stands for no subword."""
    out = np.zeros((BUCKETS + 1, SIZE), np.int32)
    draws = numbers(BUCKETS * NONZERO, 71).reshape(BUCKETS, NONZERO)
    signs = np.where(draws >> np.uint64(63), 1, -1)
    np.add.at(out, (np.arange(BUCKETS)[:, None], (draws % np.uint64(SIZE)).astype(int)), signs)
    return out


def _buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    words, bounds = hashed_words(texts, RUNS, lower=False)
    return (words & np.uint64(BUCKETS - 1)).astype(np.uint16), bounds


def add_contexts(texts: list[bytes], index: np.ndarray, total: np.ndarray) -> None:
    """Add the index vectors around every subword to the subword's row of ``total``."""
    ids, bounds = _buckets(texts)
    if not len(ids):
        return
    # Texts are set apart by places for no subword.
    lengths = np.diff(bounds)
    place = np.arange(len(ids)) + REACH * (np.repeat(np.arange(len(texts)), lengths) + 1)
    laid = np.full(len(ids) + REACH * (len(texts) + 1), BUCKETS, np.uint16)
    laid[place] = ids
    for at in range(0, len(ids), 100_000):
        own, here = ids[at : at + 100_000], place[at : at + 100_000]
        around = sum(index[laid[here + k]] for k in range(-REACH, REACH + 1) if k)
        order = np.argsort(own, kind="stable")
        sorted_ids = own[order]
        starts = np.flatnonzero(np.concatenate([[True], sorted_ids[1:] != sorted_ids[:-1]]))
        total[sorted_ids[starts]] += np.add.reduceat(around[order], starts, axis=0)


def context_vectors(docs: DataFrame) -> np.ndarray:
    """Context vectors of all buckets over all documents, of unit length; zero where a bucket is unused."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, total = index_vectors(), np.zeros((BUCKETS, SIZE), np.int64)
        for batch in batches:
            add_contexts(as_bytes(batch.column(0).to_pylist()), index, total)
        used = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), *(pa.array(total[used, i]) for i in range(SIZE))],
            names=["bucket", *(f"c{i}" for i in range(SIZE))],
        )

    schema = ", ".join(["bucket int", *(f"c{i} bigint" for i in range(SIZE))])
    parts = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(gather, schema)
    sums = parts.groupBy("bucket").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(SIZE)])
    out = np.zeros((BUCKETS + 1, SIZE), np.float32)
    rows = sums.toArrow()  # at most BUCKETS rows
    if rows.num_rows:
        values = np.stack([rows.column(f"c{i}").to_numpy() for i in range(SIZE)], axis=1).astype(np.float64)
        norms = np.linalg.norm(values, axis=1, keepdims=True)
        out[rows.column("bucket").to_numpy()] = (values / np.maximum(norms, 1.0)).astype(np.float32)
    return out


def pooled(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """Features of each text; all 0 for a text without subwords."""
    ids, bounds = _buckets(texts)
    out = np.zeros((len(texts), 2 * SIZE + 4), np.float32)
    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        if a == b:
            continue
        n, sums, squares, near = b - a, 0.0, 0.0, np.zeros(2)
        for at in range(a, b, 100_000):
            own = vectors[ids[at : min(b, at + 100_000) + 2 if at + 100_000 < b else b]]
            upto = min(100_000, len(own))
            sums = sums + own[:upto].sum(axis=0)
            squares = squares + (own[:upto] ** 2).sum(axis=0)
            for lag in (1, 2):
                near[lag - 1] += float((own[lag:] * own[: len(own) - lag])[:upto].sum())
        mean = sums / n
        out[i, :SIZE], out[i, SIZE : 2 * SIZE] = mean, np.sqrt(np.maximum(squares / n - mean**2, 0))
        out[i, 2 * SIZE :] = [near[0] / n, near[1] / n, np.linalg.norm(mean), np.log1p(n)]
    return out


@dataclass
class Network:
    """Standardised features, a hidden layer, one output divided by the temperature."""

    shift: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh((x - self.shift) / self.scale @ self.w1 + self.b1)
        return hidden @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def _loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - y * logits))


def _begin(shift: np.ndarray, scale: np.ndarray, rng: np.random.Generator) -> Network:
    size = len(shift)
    return Network(
        shift, scale,
        rng.normal(0, 1 / np.sqrt(size), (size, HIDDEN)), np.zeros(HIDDEN),
        rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), 0.0,
    )


def _descend(
    state: list[list[np.ndarray]], z: np.ndarray, y: np.ndarray, rng: np.random.Generator, *, epochs: int, step: int = 0
) -> list[list[np.ndarray]]:
    """Weights and their first and second moments after epochs of Adam; ``step`` counts the steps made before."""
    values, first, second = [list(part) for part in state]
    for _ in range(epochs):
        order = rng.permutation(len(z))
        for at in range(0, len(z), 128):
            own, target = z[order[at : at + 128]], y[order[at : at + 128]]
            hidden = np.tanh(own @ values[0] + values[1])
            error = (1 / (1 + np.exp(-np.clip(hidden @ values[2] + values[3], -30, 30))) - target) / len(own)
            back = np.outer(error, values[2]) * (1 - hidden**2)
            slopes = [own.T @ back + 1e-4 * values[0], back.sum(axis=0), hidden.T @ error + 1e-4 * values[2], error.sum(keepdims=True)]
            step += 1
            for k, slope in enumerate(slopes):
                first[k] = 0.9 * first[k] + 0.1 * slope
                second[k] = 0.999 * second[k] + 0.001 * slope**2
                rate = 0.005 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                values[k] = values[k] - rate * first[k] / (np.sqrt(second[k]) + 1e-8)
    return [values, first, second]


def _state(net: Network) -> list[list[np.ndarray]]:
    values = [net.w1, net.b1, net.w2, np.array([float(net.b2)])]
    return [values, [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]]


def _set(net: Network, values: list[np.ndarray]) -> None:
    net.w1, net.b1, net.w2, net.b2 = values[0], values[1], values[2], float(values[3][0])


def train(x: np.ndarray, y: np.ndarray, calibrate: np.ndarray, *, epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Fit the weights with Adam on the rows outside ``calibrate``, then the temperature on those inside."""
    rng = np.random.default_rng(seed)
    x, y = x.astype(np.float64), y.astype(np.float64)
    fit_x, fit_y = x[~calibrate], y[~calibrate]
    net = _begin(fit_x.mean(axis=0), fit_x.std(axis=0) + 1e-6, rng)
    _set(net, _descend(_state(net), (fit_x - net.shift) / net.scale, fit_y, rng, epochs=epochs)[0])
    if calibrate.any():
        logits = net.logits(x[calibrate])
        net.temperature = min(TEMPERATURES, key=lambda t: _loss(logits / t, y[calibrate]))
    return net


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a column of equally long lists."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _sums(rows: DataFrame) -> np.ndarray:
    """Sums of ``v`` by ``k``, places from 0 on: as many rows as the network has numbers."""
    got = rows.groupBy("k").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(got.num_rows)
    out[got.column("k").to_numpy()] = got.column("v").to_numpy()
    return out


def train_apart(rows: DataFrame, groups: int, *, epochs: int = EPOCHS, seed: int = 7) -> Network:
    """``train`` over ``doc_id``, ``label`` and features ``x`` in groups; only sums over groups leave the cluster."""
    inside = F.pmod(F.crc32(F.concat(F.lit("c"), F.col("doc_id")).cast("binary")), F.lit(CALIBRATION)) == 0
    outside = rows.filter(~inside)
    count, toward = outside.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    calibrated = 0 < toward < count
    if not calibrated:
        outside = rows
        count = rows.count()
    value = F.col("value").cast("double")
    moments = outside.select(F.posexplode("x").alias("k", "value")).groupBy("k")
    moments = moments.agg(
        *[F.sum(F.round(v * _VALUE_SCALE).cast("long")).alias(name) for name, v in (("one", value), ("two", value * value))]
    ).orderBy("k").toArrow()  # a row a feature
    mean, square = (moments.column(c).to_numpy() / _VALUE_SCALE / count for c in ("one", "two"))
    net = _begin(mean, np.sqrt(np.maximum(square - mean**2, 0)) + 1e-6, np.random.default_rng(seed))
    state = _state(net)
    shapes = [v.shape for part in state for v in part]
    cuts = np.cumsum([math.prod(shape) for shape in shapes])[:-1]
    dealt = outside.select(F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int").alias("part"), "doc_id", "label", "x")

    def descending(state: list[list[np.ndarray]], turn: int) -> Callable[[pa.Table], pa.Table]:
        before, after = epochs * turn // ROUNDS, epochs * (turn + 1) // ROUNDS

        def descend(table: pa.Table) -> pa.Table:
            order = np.argsort(table.column("doc_id").to_numpy(), kind="stable")
            z = (_matrix(table.column("x"))[order] - net.shift) / net.scale
            y = table.column("label").to_numpy()[order].astype(np.float64)
            rng = np.random.default_rng([seed, turn, table.column("part")[0].as_py()])
            done = _descend(state, z, y, rng, epochs=after - before, step=before * -(-len(z) // 128))
            flat = np.concatenate([v.ravel() for part in done for v in part])
            share = np.rint(flat * (len(z) / count) * _SCALE).astype(np.int64)
            return pa.table({"k": pa.array(np.arange(len(flat), dtype=np.int32)), "v": pa.array(share)})

        return descend

    for turn in range(ROUNDS):
        mean_of = _sums(dealt.groupBy("part").applyInArrow(descending(state, turn), "k int, v bigint")) / _SCALE
        flat = [v.reshape(shape) for v, shape in zip(np.split(mean_of, cuts), shapes, strict=True)]
        state = [flat[:4], flat[4:8], [np.maximum(v, 0) for v in flat[8:]]]
    _set(net, state[0])
    if not calibrated:
        return net

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logits, y = net.logits(_matrix(batch.column(1))), batch.column(0).to_numpy()
            lost = [round(_loss(logits / t, y) * len(y) * _VALUE_SCALE) for t in TEMPERATURES] if len(y) else [0] * len(TEMPERATURES)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(lost)), pa.int32()), pa.array(lost, pa.int64())], names=["k", "v"])

    lost = _sums(rows.filter(inside).select("label", "x").mapInArrow(losses, "k int, v bigint"))
    if len(lost):
        net.temperature = float(TEMPERATURES[np.argmin(lost)])
    return net


@dataclass
class Model:
    vectors: np.ndarray
    network: Network | None
    share: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        x = pooled(texts, self.vectors)
        empty = ~x.any(axis=1)
        if self.network is None:
            return np.where(empty, 0.0, self.share)
        return np.where(empty, 0.0, self.network.scores(x.astype(np.float64)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """The model of all documents and the labelled ones outside the held-out fold."""
    vectors = context_vectors(docs)

    def features(texts: pa.Array) -> pa.Array:
        return pa.array([list(map(float, r)) for r in pooled(as_bytes(texts.to_pylist()), vectors)], pa.list_(pa.float32()))

    rows = all_training_rows(docs, labels, label, FOLDS, HELD_OUT)
    made = F.arrow_udf(features, "array<float>")(F.col("text").cast("binary"))
    rows = rows.select("doc_id", "label", made.alias("x"))
    # Rows of one id hold one text.
    rows = rows.groupBy("doc_id").agg(F.first("label").alias("label"), F.first("x").alias("x"))
    rows = stored(rows, "quality-rows")
    n, toward = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    share = toward / n if n else 0.5
    if not n or share in (0.0, 1.0):
        return Model(vectors, None, share)
    if n > TOGETHER:
        return Model(vectors, train_apart(rows, math.ceil(n / TOGETHER)), share)
    rows = rows.toArrow()  # bounded by TOGETHER
    y = rows.column("label").to_numpy().astype(float)
    keys = rows.column("doc_id").to_pylist()
    order = np.argsort(keys, kind="stable")
    x = np.array(rows.column("x").to_pylist(), np.float32)
    calibrate = np.array([in_fold(f"c{k}", CALIBRATION) == 0 for k in keys])
    if not 0 < y[~calibrate].mean() < 1:
        calibrate[:] = False
    return Model(vectors, train(x[order], y[order], calibrate[order]), share)


def score_of(model: Model, text: Column | str) -> Column:
    """The score of a text column."""

    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.scores(as_bytes(texts.to_pylist())), pa.float64())

    return F.arrow_udf(score, "double")(F.col(text).cast("binary") if isinstance(text, str) else text.cast("binary"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents the classifier rejects: texts without subwords only, if no labels trained it."""
    model = fit(docs, labels)
    if model.network is None:
        model = replace(model, share=1.0)
    return docs.filter(score_of(model, "text") >= ACCEPTED)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents, in the columns of the contract."""
    rows = docs.select("doc_id", score_of(fit(docs, labels), "text").alias("score"))
    held = F.coalesce(fold_of("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= ACCEPTED).cast("int").alias("predicted"))
