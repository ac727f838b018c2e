"""Benchmark decontamination by latent semantic retrieval.

Every document is cut into windows of words. Windows and benchmark items are TF-IDF vectors over the
words of the items; words of more than ``MAX_SHARE`` of all windows weigh nothing, but each item
keeps its rarest words. A randomised SVD of the matrix of all windows and items gives the latent
space: the product of the matrix, its transpose and random columns is added up over the cluster in
whole numbers, and its left singular vectors are the basis. Items weigh as much as the windows
together and there are more dimensions than items in a block, so the space keeps every item apart.
A window whose projection is close to an item (cosine against the whole window) is a candidate.

A retold item may have lost just the words that weigh most. So each stretch of half windows is a
candidate too if it has as many words in common with the item as a leak needs, common words
included: no leak that lies within the words of its item and ``HALF`` more is passed over. The words
of an item that occur most, up to ``FREQUENT`` of it, are not counted at first: a stretch without
as many of the others as it then needs cannot have enough. Only the rest is counted in full.

A candidate is a leak if the longest common subsequence of words covers ``COPIED`` of the item, or
``RETOLD`` of it and the item's answer (its last words) as well: a paraphrase. Words that no item
has cannot be in a common subsequence, so only the others are kept, once, and read by all passes.

A window inside the copy of a long item has little of the whole item. So items of more than
``PASSAGE`` words are searched as passages of equal length, for one of them has at least the share
of its words that the item has; candidates are then held against the whole item.

Passages are taken in blocks, so the number and length of items is not bounded; an item of more than
``BLOCK`` passages may be reported by each of its blocks. Letter case and signs do not matter. A
null or empty text, or an item without words, matches nothing; null and repeated ids and repeated
rows are searched like all rows. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadlens.llm.common import stored
from loadlens.llm.tokens import hashed_words

#: Words of half a window; windows overlap by one half.
HALF = 24
#: Words of a passage at most.
PASSAGE = 64
MAX_SHARE = 0.02
#: A word of no more windows than this is never common.
NEVER_COMMON = 20
#: Rarest words that each passage keeps whatever their share.
RAREST = 4
#: Passages searched at once, and dimensions of their space beyond their number.
BLOCK = 256
EXTRA = 32
COSINE = 0.30
COPIED = 0.75
RETOLD = 0.55
ANSWER = 5
#: Share of an item's words, the most frequent ones, that are counted only where the others are there.
FREQUENT = 0.35
#: The items may have at most this many characters together to be sent to all tasks.
MAX_CHARS = 64 << 20
_SCALE = 1 << 16
#: Half windows whose words in common are counted at once.
STRIPE = 2048
#: Stretches whose words in common are counted in full at once.
TOGETHER = 4096

#: Letters, digits and bytes of other scripts are words.
_LETTERS = np.zeros(256, np.uint8)
_LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1

HITS = "doc_id bigint, digest bigint, terms binary, places binary"


def _words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    return hashed_words([(t or "").lower().encode() for t in texts], _LETTERS)


@dataclass
class Items:
    """Benchmark items as sequences of terms; a term is the place of a word in ``words``."""

    ids: list
    words: np.ndarray
    terms: list[np.ndarray]


def items_of(benchmark: DataFrame) -> Items:
    """All items with words. Raises if their texts are too large to send to all tasks."""
    size = benchmark.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    if size > MAX_CHARS:
        raise ValueError(f"the benchmark has {size} characters; split it into parts of {MAX_CHARS}")
    rows = benchmark.select("item_id", "text").distinct().orderBy("item_id", "text").collect()
    words, bounds = _words([r["text"] for r in rows])
    known = np.unique(words)
    own = [np.searchsorted(known, words[a:b]).astype(np.int32) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    kept = [i for i, terms in enumerate(own) if len(terms)]
    return Items([rows[i]["item_id"] for i in kept], known, [own[i] for i in kept])


@dataclass
class Passage:
    """A passage of an item, which may be all of it."""

    item: int
    terms: np.ndarray
    whole: bool


def passages_of(items: Items) -> list[Passage]:
    """The passages of all items, of about equal length within an item."""
    out = []
    for i, terms in enumerate(items.terms):
        parts = np.array_split(terms, -(-len(terms) // PASSAGE))
        out += [Passage(i, part, len(parts) == 1) for part in parts]
    return out


def _blocks(parts: list[Passage]) -> Iterator[list[Passage]]:
    """Passages in order, the passages of one item together unless they fill a block by themselves."""
    block: list[Passage] = []
    for _, own in groupby(parts, key=lambda part: part.item):
        item = list(own)
        if block and len(block) + len(item) > BLOCK:
            yield block
            block = []
        block += item
        while len(block) > BLOCK:
            yield block[:BLOCK]
            block = block[BLOCK:]
    if block:
        yield block


def _hits(docs: DataFrame, words: np.ndarray) -> DataFrame:
    """Of each document the terms of the items, in order, and their places among its words."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Most words are in no item: a table by their lower bits says so at once.
        seen, slot = np.zeros(1 << 20, bool), np.zeros(1 << 20, np.int32)
        mask = np.uint64(len(seen) - 1)
        seen[words & mask] = True
        slot[words & mask] = np.arange(len(words))
        for batch in batches:
            own, bounds = _words(batch.column(2).to_pylist())
            low = own & mask
            maybe = np.flatnonzero(seen[low])
            own, terms = own[maybe], slot[low[maybe]]
            # Where words share their lower bits, only one of them is in the table.
            other = np.flatnonzero(words[terms] != own)
            terms[other] = np.minimum(np.searchsorted(words, own[other]), len(words) - 1)
            real = words[terms] == own
            terms, places = terms[real], maybe[real]
            cuts = np.searchsorted(places, bounds)
            pairs = list(zip(cuts[:-1], cuts[1:], strict=True))
            local = [(places[a:b] - bounds[i]).astype(np.int32).tobytes() for i, (a, b) in enumerate(pairs)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()), batch.column(1),
                    pa.array([terms[a:b].tobytes() for a, b in pairs], pa.binary()), pa.array(local, pa.binary()),
                ],
                names=["doc_id", "digest", "terms", "places"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("digest"), "text").mapInArrow(find, HITS)


def _halves(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms of a batch, the half window of each (numbered over the batch), and the rows of half windows."""
    rows = batch.column("terms").to_pylist()
    counts = np.array([len(row) // 4 for row in rows], np.int64)
    terms = np.frombuffer(b"".join(rows), np.int32)
    halves = np.frombuffer(b"".join(batch.column("places").to_pylist()), np.int32) // HALF
    lengths, full = np.zeros(len(rows), np.int64), counts > 0
    lengths[full] = halves[np.cumsum(counts)[full] - 1] + 2  # the last one is empty
    first = np.append(0, np.cumsum(lengths))
    return terms, halves + np.repeat(first[:-1], counts), first


def _changes(values: np.ndarray) -> np.ndarray:
    """Where a sorted array has a value for the first time."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


def _frequencies(hits: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """Windows (of whole length, not overlapping) with each term, and all windows with terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, windows = np.zeros(n, np.int64), 0
        for batch in batches:
            terms, halves, _ = _halves(batch)
            keys = np.sort((halves // 2) * n + terms)
            total += np.bincount(keys[_changes(keys)] % n, minlength=n)
            windows += len(_changes(halves // 2))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(used, -1)), pa.array(np.append(total[used], windows))], names=["term", "n"]
        )

    sums = hits.mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(n, np.int64)
    windows = 0
    for term, got in sums:  # a row a term of the items
        if term < 0:
            windows = got
        else:
            out[term] = got
    return out, windows


def _weights(parts: list[Passage], frequency: np.ndarray, windows: int) -> np.ndarray:
    """The weight of each term: its inverse frequency, 0 for common terms."""
    weight = np.log((windows + 1.0) / (frequency + 1.0)) + 1e-3
    keep = frequency <= max(NEVER_COMMON, MAX_SHARE * windows)
    for part in parts:
        own = np.unique(part.terms)
        keep[own[np.argsort(frequency[own], kind="stable")[:RAREST]]] = True
    return np.where(keep, weight, 0.0)


def _window_rows(terms: np.ndarray, halves: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted (half, term) entries of a batch with their weights: term counts times term weights."""
    real = weight[terms] > 0
    keys, counts = np.unique(halves[real] * len(weight) + terms[real], return_counts=True)
    own = keys % len(weight)
    return keys // len(weight), own, counts * weight[own]


def _add_products(out: np.ndarray, rows: np.ndarray, to: np.ndarray, of: np.ndarray, by: np.ndarray) -> None:
    """Add to the rows ``to`` (sorted) of ``out`` the rows ``of`` of ``rows`` times ``by``."""
    starts = _changes(to)
    sizes = np.diff(np.append(starts, len(to)))
    # Sums of equal length together, as many as stay in the cache.
    for size in np.unique(sizes):
        first = starts[sizes == size]
        step = max(1, 1000 // size)
        for at in range(0, len(first), step):
            own = first[at : at + step]
            parts = own[:, None] + np.arange(size)
            out[to[own]] += np.matmul(by[parts][:, None, :], rows[of[parts]])[:, 0]


def _basis(hits: DataFrame, block: list[Passage], weight: np.ndarray) -> np.ndarray:
    """The latent space of all windows and a block of passages: one column a dimension."""
    n, size = len(weight), len(block) + EXTRA
    random = np.random.default_rng(8).standard_normal((n, size)).astype(np.float32)
    telling = np.flatnonzero(weight)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        product = np.zeros((n, size))
        for batch in batches:
            terms, halves, _ = _halves(batch)
            window, own, value = _window_rows(terms, halves // 2, weight)
            at = 0
            while at < len(own):
                # Windows stay whole.
                upto = int(np.searchsorted(window, window[min(at + 50_000, len(own) - 1)], side="right"))
                t, v = own[at:upto], value[at:upto]
                place = np.cumsum(np.diff(window[at:upto], prepend=window[at]) > 0)
                v = (v / np.sqrt(np.bincount(place, v**2))[place]).astype(np.float32)
                z = np.zeros((place[-1] + 1, size), np.float32)
                _add_products(z, random, place, t, v)
                order = np.argsort(t, kind="stable")
                _add_products(product, z, t[order], place[order], v[order])
                at = upto
        total = np.rint(product * _SCALE).astype(np.int64)
        used = telling[total[telling].any(axis=1)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int64)), *(pa.array(total[used, i]) for i in range(size))],
            names=["term", *(f"z{i}" for i in range(size))],
        )

    schema = ", ".join(["term bigint", *(f"z{i} bigint" for i in range(size))])
    sums = hits.mapInArrow(gather, schema).groupBy("term").agg(*[F.sum(f"z{i}").alias(f"z{i}") for i in range(size)])
    rows = sums.toArrow()  # a row a telling term of the items
    product = np.zeros((n, size))
    if rows.num_rows:
        product[rows.column("term").to_numpy()] = np.stack([rows.column(f"z{i}").to_numpy() for i in range(size)], axis=1)
    product /= _SCALE
    own = np.stack([_item_row(part.terms, weight) for part in block])
    scale = max(1.0, np.linalg.norm(product)) / max(1e-9, np.linalg.norm(own))
    product += scale * own.T @ (own @ random)
    basis, values, _ = np.linalg.svd(product, full_matrices=False)
    return basis[:, values > 1e-9 * max(values[0], 1e-300)].astype(np.float32)


def _item_row(terms: np.ndarray, weight: np.ndarray) -> np.ndarray:
    row = np.bincount(terms, minlength=len(weight)) * weight
    return row / max(np.linalg.norm(row), 1e-9)


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, a bit a word of ``a``."""
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for y in b.tolist():
        hit = state & where.get(y, 0)
        if hit:
            state = (state + hit | state - hit) & full
    return len(a) - state.bit_count()


def verdict(item: np.ndarray, region: np.ndarray) -> tuple[int, str | None]:
    """Words of the item in common with a region, and ``copy`` or ``paraphrase`` if it is a leak."""
    # The common subsequence has no more than the words in common, and no more than the region.
    held = set(region.tolist()) if len(region) >= RETOLD * len(item) else ()
    size = min(len(region), sum(x in held for x in item.tolist()))
    if size < RETOLD * len(item):
        return size, None
    size = common_subsequence(item, region)
    if size >= COPIED * len(item):
        return size, "copy"
    answer = item[-ANSWER:]
    if size >= RETOLD * len(item) and common_subsequence(answer, region) >= len(answer) - 1:
        return size, "paraphrase"
    return size, None


class _Common:
    """Counts the words that stretches of half windows have in common with the passages of a block."""

    def __init__(self, block: list[Passage], frequency: np.ndarray) -> None:
        own = [part.terms for part in block]
        sizes = np.array([len(t) for t in own])
        #: Half windows that hold any stretch of the passage's words and HALF more.
        self.spans = -(-(sizes + HALF - 1) // HALF) + 1
        self.retold, self.copied = (np.ceil(share * sizes - 1e-9).astype(int) for share in (RETOLD, COPIED))
        #: The answer is looked for here only where the passage is the whole item.
        self.answer = np.where([part.whole for part in block], np.minimum(sizes, ANSWER) - 1, 0)
        self.n = len(frequency)
        self.words = _times(own, self.n)
        self.last = _times([t[-ANSWER:] for t in own], self.n)
        rare, self.least = [], self.retold.copy()
        for i, t in enumerate(own):
            terms, times = np.unique(t, return_counts=True)
            # The most frequent words whose number is within the share; a leak may have them all.
            order = np.argsort(-frequency[terms], kind="stable")
            left_out = order[: int(np.searchsorted(np.cumsum(times[order]), FREQUENT * sizes[i], side="right"))]
            self.least[i] -= times[left_out].sum()
            rare.append(t[~np.isin(t, terms[left_out])])
        self.rare = _lists(rare, len(frequency))

    def stretches(self, terms: np.ndarray, halves: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """First half window, half windows, passage and words in common (at most) of all that may be leaks.

        Words lie in page order; a stretch may begin before its text and end after it.
        """
        if not len(terms):
            return
        longest = int(self.spans.max())
        order = np.argsort(terms, kind="stable")
        sorted_halves, rank = halves[order], np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        begin = np.searchsorted(terms[order], np.arange(len(self.rare[2])))
        for base in range(int(halves[0]) - longest + 1, int(halves[-1]) + 1, STRIPE):
            a, b = np.searchsorted(halves, [base, base + STRIPE + longest - 1])
            if a == b:
                continue
            own = terms[a:b], halves[a:b], rank[a:b], sorted_halves, begin, base, self.spans
            at, i = np.divmod(np.flatnonzero(_counted(*own, self.rare) >= self.least), len(self.spans))
            at += base
            starts, ends = np.searchsorted(halves, at), np.searchsorted(halves, at + self.spans[i])
            enough = np.flatnonzero(ends - starts >= self.retold[i])
            for few in np.split(enough, range(TOGETHER, len(enough), TOGETHER)):
                k, x, y = i[few], starts[few], ends[few]
                common = _common_words(terms, x, y, k, self.words, self.n)
                real = common >= self.copied[k]
                rest = np.flatnonzero(~real & (common >= self.retold[k]))
                real[rest] = _common_words(terms, x[rest], y[rest], k[rest], self.last, self.n) >= self.answer[k[rest]]
                yield from zip(at[few][real].tolist(), self.spans[k[real]].tolist(), k[real].tolist(), common[real].tolist(), strict=True)


def _times(own: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The terms of each passage, numbered on by ``n`` a passage, and how often it has them."""
    return np.unique(np.concatenate([t.astype(np.int64) + i * n for i, t in enumerate(own)]), return_counts=True)


def _common_words(
    terms: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: np.ndarray, held: tuple[np.ndarray, np.ndarray], n: int
) -> np.ndarray:
    """Words in common of each stretch of ``terms`` and a passage; a word counts as often as both have it."""
    sizes = ends - starts
    stretch = np.repeat(np.arange(len(which)), sizes)
    place = np.arange(len(stretch)) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    keys = np.repeat(which.astype(np.int64) * n, sizes) + terms[place]
    known, times = held
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    real = known[at] == keys
    found, counts = np.unique(stretch[real] * len(known) + at[real], return_counts=True)
    stretch, at = np.divmod(found, len(known))
    return np.bincount(stretch, np.minimum(counts, times[at]), len(which)).astype(np.int64)


def _lists(own: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Items and how often they have a term, by term; and where the list of each term begins."""
    item = np.repeat(np.arange(len(own)), [len(t) for t in own])
    keys, times = np.unique(np.concatenate(own).astype(np.int64) * len(own) + item, return_counts=True)
    return keys % len(own), times, np.searchsorted(keys, np.arange(n + 1) * len(own))


def _counted(
    terms: np.ndarray, halves: np.ndarray, rank: np.ndarray, sorted_halves: np.ndarray, begin: np.ndarray, base: int,
    spans: np.ndarray, lists: tuple[np.ndarray, np.ndarray, np.ndarray],
) -> np.ndarray:
    """Words in common of each item and the stretch from each half window of a stripe."""
    items, times, first = lists
    size = len(spans)
    n = first[terms + 1] - first[terms]
    place = np.arange(n.sum()) + np.repeat(first[terms] - (np.cumsum(n) - n), n)
    item = items[place]
    # A word counts unless the stretch holds as many earlier ones of its kind as the item has.
    earlier = np.repeat(rank, n) - times[place]
    before = np.where(earlier >= np.repeat(begin[terms], n), sorted_halves[earlier], base - 1)
    half = np.repeat(halves, n)
    start = np.maximum(np.maximum(half - spans[item], before) + 1 - base, 0)
    end = np.minimum(half + 1 - base, STRIPE)
    real = start < end
    item = item[real]
    change = np.bincount(start[real] * size + item, minlength=(STRIPE + 1) * size)
    change -= np.bincount(end[real] * size + item, minlength=(STRIPE + 1) * size)
    return np.cumsum(change.reshape(STRIPE + 1, size)[:STRIPE], axis=0)


def _search(
    hits: DataFrame, items: Items, block: list[Passage], weight: np.ndarray, frequency: np.ndarray, basis: np.ndarray
) -> DataFrame:
    """The best leak of each item with passages in a block in each document."""
    # What a term adds to the product of a window's projection and each passage's.
    scores = basis @ (np.stack([_item_row(part.terms, weight) for part in block]).astype(np.float32) @ basis).T
    own = {part.item: items.terms[part.item] for part in block}
    ids = {i: items.ids[i] for i in own}
    item_of = np.array([part.item for part in block])
    shared = _Common(block, frequency)

    def leaks(terms: np.ndarray, places: np.ndarray, found: list[tuple[int, int, int, int]]) -> Iterator[tuple]:
        best: dict[int, tuple] = {}
        for start, stop, i, most in found:
            if most <= best.get(i, (0,))[0]:
                continue
            a, b = np.searchsorted(places, [start, stop])
            size, kind = verdict(own[i], terms[a:b])
            if kind and size > best.get(i, (0,))[0]:
                best[i] = (size, kind, int(places[a]), int(places[b - 1]) + 1)
        for i, (size, kind, start, end) in sorted(best.items()):
            yield ids[i], size, len(own[i]), kind, start, end

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, halves, first = _halves(batch)
            half, entry, value = _window_rows(terms, halves, weight)
            found: dict[int, list] = {}
            stretches = shared.stretches(terms, halves)
            for at, upto in _whole_groups(half, first, 20_000):
                h, t, v = half[at:upto], entry[at:upto], value[at:upto]
                if not len(h):
                    continue
                base = h[0]
                span = int(h[-1] - base) + 2
                # Windows are two halves; a term in both counts with both, so its square has a cross part.
                z = np.zeros((span, len(block)), np.float32)
                _add_products(z, scores, h - base, t, v.astype(np.float32))
                squares = np.bincount(h - base, v**2, span)
                keys = (h - base) * len(weight) + t
                nxt = np.searchsorted(keys, keys + len(weight))
                twin = (nxt < len(keys)) & (keys[np.minimum(nxt, len(keys) - 1)] == keys + len(weight))
                cross = np.bincount((h - base)[twin], 2 * v[twin] * v[nxt[twin]], span)
                z[:-1] += z[1:]
                norms = squares + cross
                norms[:-1] += squares[1:]
                least = (COSINE * np.sqrt(np.maximum(norms, 1e-12))).astype(np.float32)
                window, i = np.divmod(np.flatnonzero(z >= least[:, None]), len(block))
                rows = np.searchsorted(first, window + base, side="right") - 1
                begin = (window + base - first[rows]) * HALF
                for r, start, item in zip(rows.tolist(), begin.tolist(), item_of[i].tolist(), strict=True):
                    reach = len(own[item])
                    found.setdefault(r, []).append((start - reach, start + 2 * HALF + reach, item, reach))
            for at, span, i, most in stretches:
                # A stretch may reach over several short texts.
                upto = int(np.searchsorted(first, at + span))
                for r in range(max(0, int(np.searchsorted(first, at, side="right")) - 1), min(upto, len(first) - 1)):
                    start = (at - int(first[r])) * HALF
                    item, reach = block[i].item, 0
                    if not block[i].whole:
                        most = reach = len(own[item])
                    found.setdefault(r, []).append((start - reach, start + span * HALF + reach, item, most))
            out = []
            for r, windows in found.items():
                t = np.frombuffer(batch.column("terms")[r].as_py(), np.int32)
                p = np.frombuffer(batch.column("places")[r].as_py(), np.int32)
                key = batch.column("doc_id")[r].as_py(), batch.column("digest")[r].as_py()
                out += [(*key, *leak) for leak in leaks(t, p, windows)]
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True)) for row in out], schema=schema)

    names = ("doc_id", "digest", "item_id", "common_words", "item_words", "kind", "start_word", "end_word")
    schema = pa.schema([(n, pa.string() if n == "kind" else pa.int64()) for n in names])
    return hits.mapInArrow(search, ", ".join(f"{n} {'string' if n == 'kind' else 'bigint'}" for n in names))


def _whole_groups(half: np.ndarray, first: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Stretches of about ``size`` entries that end between half windows; neighbours share one half."""
    at = 0
    while at < len(half):
        upto = int(np.searchsorted(half, half[min(at + size, len(half) - 1)], side="right"))
        yield at, upto
        if upto >= len(half):
            return
        # The last half goes into the next stretch too, as the first part of the window across the cut.
        back = int(np.searchsorted(half, half[upto - 1]))
        at = back if back > at else upto


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id``, ``digest`` (hash of the text), item, common words, kind and place of each leak."""
    items = items_of(benchmark)
    spark = docs.sparkSession
    empty = "doc_id long, digest long, item_id long, common_words long, item_words long, kind string, start_word long, end_word long"
    if not items.ids:
        return spark.createDataFrame([], empty)
    hits = stored(_hits(docs, items.words), "hits")
    frequency, windows = _frequencies(hits, len(items.words))
    parts = passages_of(items)
    weight = _weights(parts, frequency, windows)
    found = None
    for block in _blocks(parts):
        part = _search(hits, items, block, weight, frequency, _basis(hits, block, weight))
        found = part if found is None else found.union(part)
    return found


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a leak. All columns stay."""
    gone = leaks(docs, benchmark).select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).distinct()
    # By frame, for docs may have columns of the same names.
    same = docs["doc_id"].cast("long").eqNullSafe(gone["_id"]) & (F.xxhash64(docs["text"]) == gone["_digest"])
    return docs.join(gone, same, "left_anti")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All leaks, a row each."""
    return leaks(docs.select("doc_id", "text"), benchmark).drop("digest")
