"""Words of many texts as arrays of 64-bit hashes, without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Bytes handled at once. A longer text is cut between words, never inside one.
SLICE = 1 << 20
_PERIOD = 1 << 12
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)

#: 1 for bytes of words: everything but space and \t to \r.
WORDS = np.ones(256, np.uint8)
WORDS[[32, *range(9, 14)]] = 0

#: Byte kinds of subwords: 0 space, 1 letters and bytes of other scripts, 2 digits, 3 capitals, 4 and up one a symbol.
RUNS = np.arange(256, dtype=np.int32) + 4
RUNS[[32, *range(9, 14)]] = 0
RUNS[ord("a") : ord("z") + 1] = 1
RUNS[128:] = 1
RUNS[ord("0") : ord("9") + 1] = 2
RUNS[ord("A") : ord("Z") + 1] = 3

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def numbers(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * _GOLDEN + np.uint64(seed))


_FACTORS = numbers(_PERIOD, 20) | np.uint64(1)


def _slices(texts: Sequence[bytes]) -> Iterator[tuple[bytes, list[tuple[int, int]]]]:
    """Bytes to handle at once, and which text ends where in them."""
    parts: list[bytes] = []
    ends: list[tuple[int, int]] = []
    size = 0
    for i, text in enumerate(texts):
        at = 0
        while len(text) - at > SLICE:
            cut = at + SLICE
            while cut < len(text) and WORDS[text[cut]]:
                cut += 1
            piece = text[at:cut]
            at = cut
            yield b" ".join([*parts, piece]), [*ends, (i, size + len(piece))]
            parts, ends, size = [], [], 0
        parts.append(text[at:])
        size += len(text) - at
        ends.append((i, size))
        size += 1
        if size >= SLICE:
            yield b" ".join(parts), ends
            parts, ends, size = [], [], 0
    if parts:
        yield b" ".join(parts), ends


def _hashes(data: bytes, kinds: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(data, np.uint8)
    kind = kinds[raw]
    turns = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    starts = np.concatenate([[0], turns]) if len(raw) else np.zeros(0, np.int64)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    lengths = np.diff(np.append(starts, len(raw)))
    place = (np.arange(len(raw)) - np.repeat(starts, lengths)) & (_PERIOD - 1)
    values = ((LOWER[raw] if lower else raw).astype(np.uint64) + np.uint64(1)) * _FACTORS[place]
    sums = np.add.reduceat(values, starts)
    words = kind[starts] != 0
    return mixed(sums[words] + lengths[words].astype(np.uint64) * _GOLDEN), starts[words]


def hashed_words(
    texts: Sequence[bytes], kinds: np.ndarray = WORDS, lower: bool = True
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and bounds: text ``i`` has words ``bounds[i]:bounds[i + 1]``.

    A word is a run of bytes of one kind other than 0. Only A-Z is lowered.
    """
    found: list[np.ndarray] = []
    counts = np.zeros(len(texts) + 1, np.int64)
    for data, ends in _slices(texts):
        words, starts = _hashes(data, kinds, lower)
        found.append(words)
        before = 0
        for (i, _), upto in zip(ends, np.searchsorted(starts, [end for _, end in ends]), strict=True):
            counts[i + 1] += upto - before
            before = upto
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)), np.cumsum(counts)


def as_bytes(values: Sequence) -> list[bytes]:
    """Binary values as ``bytes``; nulls are empty."""
    return [bytes(v) if v is not None else b"" for v in values]
