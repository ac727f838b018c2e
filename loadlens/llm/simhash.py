"""Near duplicates by SimHash fingerprints and a Gray-order hierarchical index.

A fingerprint has 64 bits; a bit is set if it is set in over half of the hashes of a text's shingles
of three words. Two fingerprints link when at most ``BITS`` bits differ. Equal fingerprints form one
class, so copies are never compared.

Linked fingerprints agree in one of ``BITS + 1`` pieces of their bits at least, so each class is put
under the value of each piece: these masked bit patterns are the top nodes of the index. A top node
that holds more than ``GROUP`` classes is factored again over the bits still free, until it is small
or so few bits are left that it cannot hold many. Below a top node the classes are sorted by Gray
rank, so that neighbours differ in few bits, and ``FAN`` neighbours make a node, ``FAN`` nodes a
higher node: a node holds the mask and pattern of all bits that its classes share. The search walks
down from pairs of nodes and adds up the differing bits that both masks know; a pair of nodes with
more than ``BITS`` of them is dropped with everything below it, as is a pair whose classes are all
in one component already. Links found become components.

All classes are searched and the search is exact. A text without words (null, empty, blank) has the
fingerprint zero, which links like any other. Rows with one id and different texts are different
documents; repeated rows are copies. A row with a null id keeps ``component_id`` null if no id is
reachable. An empty table gives an empty result. Very long texts are read piece by piece. Further
columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadlens.llm.common import stored
from loadlens.llm.graph import components, looked_up

SHINGLE = 3
SEED = 42
#: Links differ in at most so many bits.
BITS = 3
#: Classes under a top node, unless at most ``FREE`` of their bits may differ.
GROUP = 16_384
FREE = 16
FAN = 8
#: Pairs of nodes looked at together, and classes a task holds besides one group.
CHUNK = 1 << 19
HELD = 1 << 16
#: A list of at most this many keys of 20 bytes is sent to all tasks.
BROADCAST_ROWS = 400_000

#: Bytes of a text read at once.
SLICE = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_ALL = np.uint64(2**64 - 1)


def _word_lists(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a list a slice."""
    at = 0
    while at < len(text):
        cut = _SPACE.search(text, at + SLICE)
        end = cut.start() if cut else len(text)
        yield text[at:end].lower().split()
        at = end


def fingerprint(text: bytes | None) -> int:
    """The SimHash of a text's shingles, as an unsigned number."""
    total, counts, before = 0, np.zeros(64, np.int64), []
    for words in _word_lists(text or b""):
        words = before + words
        before = words[-(SHINGLE - 1) :]
        if len(words) < SHINGLE:
            continue
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate(([0], ends[:-SHINGLE])).tolist()
        spans = zip(starts, (ends[SHINGLE - 1 :] - 1).tolist(), strict=True)
        hashes = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans), "<u8", len(starts))
        for i in range(0, len(hashes), 1 << 14):
            part = hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8)
            counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(hashes)
    if not total:
        return xxhash.xxh64_intdigest(b" ".join(before), SEED) if before else 0
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def _fingerprinted(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``print``, the fingerprint as a signed number."""

    def made(texts: pa.Array) -> pa.Array:
        found = (fingerprint(t.as_py()) for t in texts)
        return pa.array(np.fromiter(found, np.uint64, len(texts)).view(np.int64))

    return docs.select("doc_id", F.arrow_udf(made, "bigint")(F.col("text").cast("binary")).alias("print"))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def finer(mask: int) -> list[int]:
    """Masks of one more piece each: the bits that ``mask`` leaves free, cut in ``BITS + 1``."""
    free = [k for k in range(64) if not mask >> k & 1]
    cuts = [len(free) * i // (BITS + 1) for i in range(BITS + 2)]
    return [mask | sum(1 << k for k in free[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _under(prints: DataFrame, masks: list[int]) -> DataFrame:
    """Each fingerprint under the next top nodes, from those of ``masks``."""
    nexts = {m: F.array(*[F.lit(_signed(x)).cast("long") for x in finer(m)]) for m in masks}
    first, *rest = nexts.items()
    pieces = F.when(F.col("mask") == _signed(first[0]), first[1])
    for m, found in rest:
        pieces = pieces.when(F.col("mask") == _signed(m), found)
    found = prints.select("print", F.explode(pieces).alias("mask"))
    return found.select("mask", F.col("print").bitwiseAND(F.col("mask")).alias("key"), "print")


def gray_rank(value: Column) -> Column:
    """The place of a number in the order of the Gray code."""
    for shift in (1, 2, 4, 8, 16, 32):
        value = value.bitwiseXOR(F.shiftrightunsigned(value, shift))
    return value


class Index:
    """Nodes over fingerprints in Gray order, group by group; a group ends in one top node."""

    def __init__(self, prints: np.ndarray, starts: np.ndarray):
        #: By level: shared bits, their pattern, and the first node below (the next node's is the end).
        self.masks, self.patterns, self.below = [np.full(len(prints), _ALL)], [prints], []
        ones, zeros = prints, ~prints
        #: For each level the groups' first nodes.
        firsts = starts
        while True:
            n = len(ones)
            sizes = np.diff(np.append(firsts, n))
            if sizes.max() == 1:
                break
            runs = -(-sizes // FAN)
            place = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
            heads = np.repeat(firsts, runs) + FAN * place
            ones, zeros = np.bitwise_and.reduceat(ones, heads), np.bitwise_and.reduceat(zeros, heads)
            self.masks.append(ones | zeros)
            self.patterns.append(ones)
            self.below.append(np.append(heads, n))
            firsts = np.cumsum(runs) - runs

    def spans(self, level: int) -> np.ndarray:
        """The first fingerprint of each node of a level."""
        at = np.arange(len(self.masks[level]))
        for k in range(level - 1, -1, -1):
            at = self.below[k][at]
        return at


def _joined(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after ``a`` and ``b`` are linked; a label is the least place of its component."""
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return labels
        np.minimum.at(labels, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while not np.array_equal(further := labels[labels], labels):
            labels = further


def _expanded(index: Index, level: int, pairs: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Pairs of nodes one level below, with known bits and differences."""
    a, b, known, apart = pairs
    below = index.below[level - 1]
    n_a, n_b = below[a + 1] - below[a], below[b + 1] - below[b]
    n = n_a * n_b
    of = np.repeat(np.arange(len(a)), n)
    place = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    x, y = below[a][of] + place // n_b[of], below[b][of] + place % n_b[of]
    once = x < y if level == 1 else x <= y
    x, y, of = x[once], y[once], of[once]
    masks, patterns = index.masks[level - 1], index.patterns[level - 1]
    both = masks[x] & masks[y]
    # Only bits that the nodes above did not know add to their differences.
    apart = apart[of] + np.bitwise_count((patterns[x] ^ patterns[y]) & both & ~known[of])
    near = apart <= BITS
    return x[near], y[near], both[near], apart[near]


def linked(prints: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each fingerprint the first place of its component; groups begin at ``starts``, each in Gray order."""
    index = Index(prints, starts)
    labels = np.arange(len(prints))
    # Neighbours in Gray order first: most links are there, and what they join is not compared again.
    same = np.ones(len(prints) - 1, bool)
    same[starts[1:] - 1] = False
    next_to = np.flatnonzero(same & (np.bitwise_count(prints[1:] ^ prints[:-1]) <= BITS))
    labels = _joined(labels, next_to, next_to + 1)

    top = len(index.below)
    spans = [index.spans(k) for k in range(top + 1)]
    nodes = np.arange(len(index.masks[top]))
    stack = [(top, (nodes, nodes, np.zeros(len(nodes), np.uint64), np.zeros(len(nodes), np.uint8)))]
    while stack:
        level, pairs = stack.pop()
        if not level:
            labels = _joined(labels, pairs[0], pairs[1])
            continue
        least, most = np.minimum.reduceat(labels, spans[level]), np.maximum.reduceat(labels, spans[level])
        a, b = pairs[:2]
        open_ = np.flatnonzero((least[a] != most[a]) | (least[b] != most[b]) | (least[a] != least[b]))
        for i in range(0, len(open_), CHUNK // FAN**2):
            part = open_[i : i + CHUNK // FAN**2]
            found = _expanded(index, level, tuple(x[part] for x in pairs))
            if len(found[0]):
                stack.append((level - 1, found))
    return labels


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that join the components of each group; rows come sorted by group and Gray rank."""

    def done(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)))
        sizes = np.diff(np.append(starts, len(rows)))
        more = np.repeat(sizes > 1, sizes)
        prints, sizes = rows[more, 2], sizes[sizes > 1]
        if len(sizes):
            labels = linked(prints.view(np.uint64), np.cumsum(sizes) - sizes)
            moved = np.flatnonzero(labels != np.arange(len(labels)))
            yield pa.RecordBatch.from_arrays([pa.array(prints[moved]), pa.array(prints[labels[moved]])], names=["a", "b"])

    held: list[np.ndarray] = []
    for batch in batches:
        held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1))
        if sum(map(len, held)) >= HELD:
            rows = np.concatenate(held)
            last = np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(axis=1))
            whole = last[-1] + 1 if len(last) else 0
            if whole:
                yield from done(rows[:whole])
            held = [rows[whole:]]
    if held:
        yield from done(np.concatenate(held))


def links(classes: DataFrame) -> DataFrame:
    """``a`` and ``b``: links enough to join every component of the distinct fingerprints in ``print``."""
    found, masks = None, [0]
    current = classes.select("print", F.lit(0).cast("long").alias("mask"))
    while True:
        current = stored(_under(current, masks), "under")
        masks = [x for m in masks for x in finer(m)]
        ends = min(64 - m.bit_count() for m in masks) <= FREE
        rest = None
        if not ends:
            large = stored(current.groupBy("mask", "key").agg(F.count("*").alias("n")).filter(F.col("n") > GROUP), "large")
            n = large.count()
            if n:
                keys = large.select("mask", "key")
                keys = F.broadcast(keys) if n <= BROADCAST_ROWS else keys
                rest = current.join(keys, ["mask", "key"], "left_semi").select("print", "mask")
                current = current.join(keys, ["mask", "key"], "left_anti")
        ordered = current.repartition("mask", "key").sortWithinPartitions("mask", "key", gray_rank(F.col("print")))
        part = stored(ordered.mapInArrow(_searched, "a bigint, b bigint"), "links")
        found = part if found is None else found.union(part)
        if rest is None:
            return found
        current = rest


def membership(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``print`` and ``component_id`` of all documents."""
    own = stored(_fingerprinted(docs), "prints")
    classes = stored(own.groupBy("print").agg(F.min("doc_id").alias("label")), "classes")
    # Most classes have no link; only those with one look up their component.
    comps = components(links(classes)).withColumnRenamed("node", "print").join(classes, "print")
    least = comps.groupBy("comp").agg(F.min("label").alias("component_id"))
    found = looked_up(comps, "comp", least, F.col("print")).select("print", "component_id")
    named = classes.join(found, "print", "left").select("print", F.coalesce("component_id", "label").alias("component_id"))
    # Stored first: with plain exchanges on both sides Spark splits the rows of a hot fingerprint.
    return own.join(stored(named, "named"), "print")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints and components of all documents, in the columns of the contract."""
    found = membership(docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
