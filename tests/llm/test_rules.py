"""Distances and verdicts of the quality rules against a plain version, and bounds of training rows."""

from __future__ import annotations

import math
import random
import re
import unicodedata
from collections import Counter, defaultdict

import pytest

from loadlens.llm import labelled, quality_rules as rules
from tests.llm.conftest import SCHEMA, prose

LISTS = {name: words.split() for name, words in rules.COMMON_WORDS.items()}


def histograms(text, lang):
    letters = re.findall(r"[^\W\d_]+", text.lower())
    if lang is None:
        lang = max(LISTS, key=lambda n: (sum(w in LISTS[n] for w in letters), -list(LISTS).index(n)))
    kinds = [lambda c: unicodedata.category(c) == "Lu", lambda c: unicodedata.category(c) == "Nd", lambda c: c in ".,;:!?'\"()-",
             lambda c: c in " \t\n\x0b\x0c\r", lambda c: c in "#*$%&|<>"]
    chars = [sum(map(k, text)) for k in kinds]
    chars.append(len(text) - sum(chars))
    if lang not in LISTS:
        return None, chars, None, None
    common = Counter(w for w in letters if w in LISTS[lang])
    return lang, chars, [common[w] for w in LISTS[lang]], [common.total(), len(letters) - common.total()]


def distance(p, q):
    if not sum(p) or not sum(q):
        return None
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    parts = [x * math.log2(2 * x / (x + y)) for a, b in ((p, q), (q, p)) for x, y in zip(a, b, strict=True) if x]
    return math.sqrt(max(sum(parts) / 2, 0))


def plain(data, failed):
    own = [histograms(t or "", lang) for _, t, lang in data]
    total = defaultdict(list)
    for h, out in zip(own, failed, strict=True):
        if not out:
            total[h[0]].append(h)
    add = lambda rows: [sum(x) for x in zip(*rows, strict=True)]
    found = []
    for lang, chars, words, cover in own:
        of = total[lang]
        everyone = [h[1] for rows in total.values() for h in rows]
        refs = (add(everyone if lang is None else [h[1] for h in of]), add([h[2] for h in of]) if lang else None, add([h[3] for h in of]) if lang else None)
        found.append(tuple(distance(c, r) if c is not None and r else None for c, r in zip((chars, words, cover), refs, strict=True)))
    return found


@pytest.fixture(scope="module")
def corpus(llm):
    draw = random.Random(4)

    def sound(seed, lang, n):
        return " ".join(draw.choice(LISTS[lang]) if draw.random() < 0.3 else w for w in prose(seed, n).split()).capitalize() + "."

    data = [(i, sound(i, lang, 60 + 5 * (i % 30)), lang) for i, lang in enumerate(["en", "fr", "de", "es"] * 25)]
    data += [(200 + i, sound(300 + i, "en", 60), None if i % 2 else "en") for i in range(4)]
    junk = lambda: " ".join("".join(draw.choices("bcdfghjklmnp", k=6)) for _ in range(300))
    data += [(500 + i, junk(), lang) for i, lang in enumerate(["en", "fr", "de", "es", None])]
    data += [(600, junk(), "it"), (601, None, "en"), (602, "", None), (603, "one two", "en"), (604, prose(9, 55), "en")]
    return llm.createDataFrame([(i, t, lang, "s", 1) for i, t, lang in data], SCHEMA).repartition(3)


def test_distances_as_plain_sums(corpus):
    rows = rules.measured(corpus).collect()
    want = plain([(r["doc_id"], r["text"], r["lang"]) for r in rows], [r["base_failed"] for r in rows])
    for r, expected in zip(rows, want, strict=True):
        got = tuple(r[c] for c in ("char_distance", "word_distance", "cover_distance"))
        assert [g is None for g in got] == [e is None for e in expected], r
        assert all(g is None or abs(g - e) < 1e-9 for g, e in zip(got, expected, strict=True)), r


def test_texts_without_common_words_go_and_sound_ones_stay(corpus):
    kept = {r["doc_id"]: r["kept"] for r in rules.judged(corpus).collect()}
    assert all(kept[i] for i in range(100)) and all(kept[200 + i] for i in range(4))
    assert not any(kept[500 + i] for i in range(5))
    assert kept[600]  # another language: no list to hold it against
    assert kept[604]  # too few words to judge
    assert not kept[601] and not kept[602] and not kept[603]


def test_columns_of_the_input_stay_and_new_ones_replace(corpus):
    named = corpus.withColumns({"n_words": corpus["lang"], "_text": corpus["lang"], "kept": corpus["lang"]})
    got = rules.measured(named)
    assert got.columns[:6] == [*corpus.columns, "_text"] and got.columns[6:] == list(rules.FIGURES)
    assert dict(got.dtypes)["n_words"] == "bigint" and got.count() == corpus.count()
    assert rules.measured(corpus.limit(0)).count() == 0


def test_a_repeated_id_trains_once(llm, monkeypatch):
    """One labelled id holds most rows, with two texts; rows stay within the labelled ids."""
    rows = [(7, "hot text")] * 30_000 + [(7, "other text")] * 50 + [(i, f"text {i}") for i in range(200)] + [(None, "x"), (5, None)]
    docs = llm.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = llm.createDataFrame([(i, i % 2) for i in range(150)] + [(7, 0)], "doc_id long, toxic int")
    got = labelled.training_rows(docs, labels, "toxic", 3, 1).collect()
    ids = [r["doc_id"] for r in got]
    assert len(ids) == len(set(ids)) and 7 in ids and len(ids) < 150
    assert next(r["label"] for r in got if r["doc_id"] == 7) == 1
    monkeypatch.setattr(labelled, "SAMPLE", 20)
    assert len(labelled.training_rows(docs, labels, "toxic", 3, 1).collect()) < 60
