"""Personal data, also in disguise, with spans in the source text.

Plain finds (email, ip, card, phone) come from the text as it is. Then transducers write a normalised
text: look-alike characters become ASCII, spelled digits become digits, and written-out ``at`` and
``dot`` become signs. Each character of the normalised text knows the source characters it stands
for, so what is found there is mapped back. A span found so is added unless a plain find of its kind
holds it already.

Positions are code points, ends are exclusive. A null or empty text has no spans, a very long text is
read whole. Rows are handled by themselves, so null ids, repeated rows and further columns do not
matter; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
SPANS = "array<struct<kind:string,start:int,end:int,plain:boolean>>"
_ARROW = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("plain", pa.bool_())])
)

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# The look-behind only spares attempts inside a run of digits, which fail as the one at its start does.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# Look-alikes of ASCII characters.
_LOOKALIKE = dict(
    zip("аеорсухіјѕкмтнвАЕОРСУХІЈЅКМТНВαορνικτΑΒΕΗΙΚΜΝΟΡΤΧ", "aeopcyxijskmthbAEOPCYXIJSKMTHBaopviktABEHIKMNOPTX", strict=True)
)
_LOOKALIKE |= {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}
for _zero in (0x0660, 0x06F0, 0x0966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6):
    _LOOKALIKE |= {chr(_zero + i): str(i) for i in range(10)}
_LOOKALIKE |= dict.fromkeys("      　", " ")
_LOOKALIKE |= dict.fromkeys("‐‑‒–−﹣", "-")
_LOOKALIKE |= {"․": ".", "。": ".", "﹒": ".", "﹫": "@", "﹢": "+"}
_DROPPED = "­​‌‍⁠﻿"
_ODD = frozenset("".join(_LOOKALIKE) + _DROPPED)
_TABLE = str.maketrans(_LOOKALIKE | dict.fromkeys(_DROPPED))

# Digits in words, from 0 to 9.
_SPELLED = (
    "zero oh zéro null cero", "one un eins uno", "two deux zwei dos", "three trois drei tres",
    "four quatre vier cuatro", "five cinq fünf cinco", "six sechs seis", "seven sept sieben siete",
    "eight huit acht ocho", "nine neuf neun nueve",
)
_VALUE = {w: str(i) for i, words in enumerate(_SPELLED) for w in words.split()}
_VALUE |= dict.fromkeys(("dot", "point", "punkt", "punto"), ".") | {"plus": "+"}
_SPELT = "|".join(sorted(_VALUE, key=len, reverse=True))
_DOT = r"(?:dot|point|punkt|punto)"
#: Seven or more digits or signs of which at least three are written as words. Digits begin a run only before a dot in words.
_RUN = re.compile(
    rf"(?<!\w)(?:{_SPELT}|[0-9]+(?=[ ,-]{{1,2}}{_DOT}[ ,-]))(?:[ ,-]{{1,2}}(?:{_SPELT}|[0-9]+)){{6,}}(?!\w)", re.IGNORECASE
)
_LETTERS = re.compile(r"[^\W\d_]+")
_PIECE = re.compile(rf"{_SPELT}|[0-9]+", re.IGNORECASE)
_AT = r"(?:at|arobase|arroba)"
_SIGNS = re.compile(
    rf"(?P<at>[ ]?[\[({{<][ ]?{_AT}[ ]?[\])}}>][ ]?)|(?P<dot>[ ]?[\[({{<][ ]?{_DOT}[ ]?[\])}}>][ ]?)", re.IGNORECASE
)
# Ends of host names that make bare words an address: any two letters that are no other word, and longer ones.
_NO_END = "ah|ex|go|he|if|oh|ok|on|or|up|we"
_ENDS = rf"(?!(?:{_NO_END})(?!\w))[a-z]{{2}}|com|org|net|edu|gov|mil|int|info|biz|name|dev|app|shop|site|online|tech|cloud|xyz"
# Words that stand before a noun, so that "at this point in" is no address.
_NO_HOST = "a|an|the|this|that|these|those|each|every|any|some|no|one|my|your|his|her|its|our|their|which|what"
_BARE = re.compile(
    rf"[A-Za-z0-9_%+-]+(?:[ ]{_DOT}[ ][A-Za-z0-9_%+-]+)?(?P<at>[ ]{_AT}[ ](?!(?:{_NO_HOST})[ ])|@)[A-Za-z0-9-]+(?:[ ]{_DOT}[ ][A-Za-z0-9-]+)*[ ]{_DOT}[ ](?:{_ENDS})(?!\w)",
    re.IGNORECASE,
)
_BARE_SIGN = re.compile(rf"[ ](?:(?P<at>{_AT})|{_DOT})[ ]", re.IGNORECASE)
_DOT_WORD = re.compile(rf" {_DOT} ", re.IGNORECASE)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            floor = found.end()
            yield start, floor
        at = text.find("@", max(at + 1, floor))


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _card(found: str) -> bool:
    digits = found.replace(" ", "").replace("-", "")
    return 13 <= len(digits) <= 19 and _luhn(digits)


def plain_spans(text: str) -> list[tuple[str, int, int]]:
    """Personal data as written, by kind and start; leftmost, not overlapping within a kind."""
    spans = [("email", *s) for s in _emails(text)]
    if _DIGIT.search(text):
        spans += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_byte, m[0].split(".")))]
        spans += [("card", *m.span()) for m in _CARD.finditer(text) if m.end() - m.start() > 12 and _card(m[0])]
        spans += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return spans


class _Tape:
    """A text and, for each of its characters, where the source characters it stands for begin and end."""

    def __init__(self, source: str) -> None:
        self.text, self.begin = source, np.arange(len(source), dtype=np.int32)
        self.end = self.begin + 1
        self.changed = False

    def look_alikes(self) -> None:
        if not self.text.isascii() and not _ODD.isdisjoint(self.text):
            kept = np.fromiter((c not in _DROPPED for c in self.text), bool, len(self.text))
            self.text, self.begin, self.end = self.text.translate(_TABLE), self.begin[kept], self.end[kept]
            self.changed = True

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace stretches, given in order, each by some characters that all stand for the whole stretch."""
        if not edits:
            return
        at, text, begin, end = 0, [], [], []
        for start, stop, new in edits:
            text += [self.text[at:start], new]
            begin += [self.begin[at:start], np.full(len(new), self.begin[start], np.int32)]
            end += [self.end[at:start], np.full(len(new), self.end[stop - 1], np.int32)]
            at = stop
        self.text = "".join([*text, self.text[at:]])
        self.begin = np.concatenate([*begin, self.begin[at:]])
        self.end = np.concatenate([*end, self.end[at:]])
        self.changed = True

    def spelled_digits(self) -> None:
        # Cheaper than the pattern, and never stricter: are there three words that mean digits at all?
        if sum(map(_VALUE.__contains__, _LETTERS.findall(self.text.lower()))) < 3:
            return
        edits = []
        for run in _RUN.finditer(self.text):
            pieces = list(_PIECE.finditer(self.text, *run.span()))
            if sum(not p[0].isdigit() for p in pieces) < 3:
                continue
            upto = run.start()
            for p in pieces:
                if p.start() > upto:
                    edits.append((upto, p.start(), ""))
                new = _VALUE.get(p[0].lower())
                if new is not None:
                    edits.append((*p.span(), new))
                upto = p.end()
        self.rewrite(edits)

    def signs(self) -> None:
        if any(opening in self.text for opening in "[({<"):
            self.rewrite([(*m.span(), "@" if m["at"] else ".") for m in _SIGNS.finditer(self.text)])
        if _DOT_WORD.search(self.text):
            self.rewrite(
                [
                    (*s.span(), "@" if s["at"] else ".")
                    for m in _BARE.finditer(self.text)
                    for s in _BARE_SIGN.finditer(self.text, *m.span())
                ]
            )


def all_spans(text: str) -> list[tuple[str, int, int, bool]]:
    """Plain spans and those found in the normalised text, by kind as listed, then by start."""
    plain = plain_spans(text)
    spans = [(*s, True) for s in plain]
    tape = _Tape(text)
    tape.look_alikes()
    tape.spelled_digits()
    tape.signs()
    if tape.changed:
        seen = set(plain)
        # Plain spans of a kind do not overlap, so only the last one that begins in time can hold another.
        starts = {k: [s for kind, s, _ in plain if kind == k] for k in KINDS}
        ends = {k: [e for kind, _, e in plain if kind == k] for k in KINDS}
        for kind, start, stop in plain_spans(tape.text):
            span = (kind, int(tape.begin[start]), int(tape.end[stop - 1]))
            last = bisect_right(starts[kind], span[1]) - 1
            held = last >= 0 and span[2] <= ends[kind][last]
            if not held and span not in seen:
                seen.add(span)
                spans.append((*span, False))
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def _found(texts: pa.Array) -> pa.Array:
    rows = [
        [{"kind": k, "start": s, "end": e, "plain": p} for k, s, e, p in all_spans(t)] if t else []
        for t in texts.to_pylist()
    ]
    return pa.array(rows, _ARROW)


def _masked(texts: pa.Array) -> pa.Array:
    return pa.array([masked_text(t) if t else t for t in texts.to_pylist()], pa.string())


def masked_text(text: str) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans as one."""
    out, upto = [], 0
    for start, end, kind in sorted((s, -e, k) for k, s, e, _ in all_spans(text)):
        if -end <= upto:
            continue
        if start >= upto:
            out += [text[upto:start], f"<{kind}>"]
        upto = -end
    return "".join([*out, text[upto:]])


def spans_of(text: Column | str) -> Column:
    """The spans of a text column."""
    return F.arrow_udf(_found, SPANS)(text)


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` masked, and ``n_chars`` counted anew if it is there."""
    done = docs.withColumn("text", F.arrow_udf(_masked, "string")("text"))
    return done.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else done


def _written(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def found(docs: DataFrame) -> DataFrame:
    """Finds of all documents, in the columns of the contract. Counts are of plain finds; ``n_added`` of the others."""
    rows = docs.select("doc_id", spans_of("text").alias("all")).withColumn("base", F.filter("all", lambda s: s["plain"]))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return rows.select(
        "doc_id",
        *[count(k) for k in KINDS],
        F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
        _written(F.col("all")).alias("spans"),
        (F.size("all") - F.size("base")).cast("long").alias("n_added"),
    )
