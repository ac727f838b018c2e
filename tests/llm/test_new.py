"""The Merkle manifest, SimHash and spelling variants against plain versions."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from loadlens.llm import graph, merkle, queries, simhash, spelling
from tests.llm.conftest import SCHEMA, prose

CAPITALS = {k: k + 32 for k in range(65, 91)}


def plain(docs):
    return [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# Merkle manifest


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)])


def tree(nodes):
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            start = p // 16 * 16
            paths[i].append((nodes[start:p], nodes[p + 1 : start + 16]))
            at[i] = p // 16
        nodes = [digest(*nodes[k : k + 16]) for k in range(0, len(nodes), 16)]
    return nodes[0], paths


def manifest(table):
    by = defaultdict(list)
    for r in table:
        by[r[1]].append((r[0] is not None, r[0] or 0, leaf(r, r[4]), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    subs = {s: tree([x[2] for x in sorted(by[s])]) for s in names}
    root, above = tree([subs[s][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for (_, _, own, r), path in zip(sorted(by[s]), subs[s][1], strict=True):
            node = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                node = leaf(r, r[4].translate(CAPITALS))
            for left, right in path + above[k]:
                node = digest(*left, node, *right)
            proof = digest(*[h for left, right in path + above[k] for h in left + right])
            out.append((r[0], own, subs[s][0], root, proof, node, node == root))
    return sorted(out, key=repr)


def test_manifest_of_odd_rows_and_sources(docs, llm):
    assert rows(merkle.proved(docs)) == manifest(plain(docs))
    odd = [(i, f"Text {i}", None, s, i) for i, s in enumerate([None, "", "-", "é", "z", "\U0001f600", "a", "a"])]
    table = llm.createDataFrame([(i, t, lang, s, n) for i, t, lang, s, n in odd], SCHEMA)
    assert rows(merkle.proved(table)) == manifest(plain(table))


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257, 600])
def test_levels_and_blocks(llm, n):
    """A tree of one block, of a block and one leaf, and of several sources beside it."""
    table = [(i, f"Doc {i % 7}", "en", "hot" if i < n else f"s{i}", 5) for i in range(n + (20 if n > 256 else 0))]
    made = llm.createDataFrame(table, SCHEMA).repartition(5)
    assert rows(merkle.proved(made)) == manifest(plain(made))


def test_repeated_rows_are_split_and_take_neighbouring_places(llm):
    made = llm.createDataFrame([(1, "A b", "en", "s", 3)] * 700 + [(None, None, None, None, None)] * 3, SCHEMA).repartition(4)
    assert rows(merkle.proved(made)) == manifest(plain(made))


def test_tampering_is_seen_where_the_text_changes(docs):
    for r in merkle.proved(docs).collect():
        if r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5:
            assert r["verified"]


# SimHash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_components(prints, ids):
    """The least id within reach, by looking at every pair."""
    prints = np.array(prints, np.uint64)
    near = [np.flatnonzero(np.bitwise_count(prints ^ p) <= 3) for p in prints]
    label = np.arange(len(prints))
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            break
        label = new
    return [min((ids[j] for j in np.flatnonzero(label == x) if ids[j] is not None), default=None) for x in label]


def test_fingerprints_and_components_as_every_pair(docs, llm):
    close = [(100 + k, prose(500, 400) + f" tail{k}", "en", "s", 1) for k in range(8)]
    table = docs.select("doc_id", "text", "lang", "source", "n_chars").union(llm.createDataFrame(close, SCHEMA))
    data = [(r["doc_id"], r["text"]) for r in table.collect()]
    prints = [plain_fingerprint(t) for _, t in data]
    comps = plain_components(prints, [i for i, _ in data])
    want = sorted([(i, f"{p:016x}", c) for (i, _), p, c in zip(data, prints, comps, strict=True)], key=repr)
    found = rows(simhash.fingerprints(table))
    assert found == want
    assert len({c for i, _, c in found if i is not None and i >= 100}) < 8


def test_fingerprint_of_slices(monkeypatch):
    text = prose(9, 3000).encode() + b"\n" + b"x" * 500 + b" Tail End"
    whole = plain_fingerprint(text.decode())
    for size in (7, 100, 4096):
        monkeypatch.setattr(simhash, "SLICE", size)
        assert simhash.fingerprint(text) == whole


def gray_order(prints, groups):
    rank = prints.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return np.lexsort((rank, groups))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(2, 400), st.integers(1, 5), st.booleans())
def test_index_finds_what_every_pair_does(seed, n, flips, parted):
    draw = np.random.default_rng(seed)
    prints = draw.integers(0, 2**63, max(1, n // 15), dtype=np.uint64)[draw.integers(0, max(1, n // 15), n)]
    for _ in range(flips):
        prints = prints ^ (np.uint64(1) << draw.integers(0, 20, n).astype(np.uint64))
    prints = np.unique(prints)
    groups = (prints >> np.uint64(60)).astype(int) * parted
    order = gray_order(prints, groups)
    prints, groups = prints[order], groups[order]
    starts = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
    near = (np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3) & (groups[:, None] == groups[None, :])
    label = np.arange(len(prints))
    while not (label == (new := np.array([label[x].min() for x in near]))).all():
        label = new
    assert (simhash.linked(prints, starts) == label).all()


def test_large_top_nodes_are_factored_again(llm, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP", 20)
    draw = np.random.default_rng(5)
    prints = np.unique(np.int64(77 << 40) ^ (np.int64(1) << draw.integers(0, 40, 900)) ^ (np.int64(1) << draw.integers(0, 40, 900)))
    prints = prints ^ (np.int64(1) << draw.integers(20, 63, len(prints)))
    prints = np.unique(prints)
    found = simhash.links(llm.createDataFrame([(int(p),) for p in prints], "print bigint")).collect()
    comps = graph.components(llm.createDataFrame(found, "a bigint, b bigint")).collect()
    got = {r["node"]: r["comp"] for r in comps}
    want = plain_components(prints.view(np.uint64), [int(p) for p in prints])
    assert [got.get(int(p), int(p)) for p in prints] == want


def test_masks_leave_each_pair_a_common_piece():
    for mask in (0, 0xFFFF, 0xFFFF << 48):
        pieces = [m & ~mask for m in simhash.finer(mask)]
        assert len(pieces) == 4 and sum(pieces) == (2**64 - 1) & ~mask


def test_components_of_a_long_chain_and_a_star(llm):
    pairs = [(i, i + 1) for i in range(300)] + [(1000, 1001 + i) for i in range(300)] + [(5, 5), (7, 6), (7, 6)]
    got = dict(rows(graph.components(llm.createDataFrame(pairs, "a bigint, b bigint"))))
    assert got == {**dict.fromkeys(range(301), 0), **dict.fromkeys(range(1000, 1301), 1000)}


# Spelling variants


def plain_words(data):
    found = Counter()
    for i, text in data:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(CAPITALS)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 5 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=repr)


VARIED = [("separate", 700), ("seperate", 130), ("seperat", 20), ("separates", 130), ("éclairs", 30), ("eclairs", 6),
          ("Éclairs", 6), ("aaaaaa", 60), ("aaaaaaa", 12), ("aaaaab", 12), ("baaaaa", 60), ("abaaaa", 6), ("short", 90)]


def test_variants_as_every_pair(docs, llm):
    text = " ".join(f"{w}." * n for w, n in VARIED)
    table = docs.select("doc_id", "text").union(llm.createDataFrame([(900, text), (None, "Separate " * 9)], "doc_id long, text string"))
    data = [(r["doc_id"], r["text"]) for r in table.collect()]
    words = plain_words(data)
    got = rows(spelling.grouped(table))
    assert got == plain_variants(words)
    assert {"seperat": "separate", "eclairs": "éclairs"}.items() <= {r[0]: r[2] for r in got}.items()


def test_blocks_of_a_half_find_the_same(llm, monkeypatch):
    monkeypatch.setattr(spelling, "INDEXED", 7)
    draw = np.random.default_rng(3)
    words = {"".join(draw.choice(list("abé"), int(draw.integers(6, 9)))): int(draw.integers(5, 90)) for _ in range(250)}
    table = llm.createDataFrame(list(words.items()), "word string, n bigint")
    # The classes below read their parameters in workers, so blocks are made by Spark and searched here.
    dealt = spelling._dealt(table)
    assert dealt.select("block").distinct().count() > 1
    found = {r["word"]: r for r in spelling.variants(table).collect()}
    for w in words:
        near = [v for v in words if one_edit(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        assert (found[w]["n_near"], found[w]["form"]) == (len(near), best)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abÿ", min_size=6, max_size=8), min_size=1, max_size=90, unique=True), st.sampled_from([0, 3]))
def test_bitsets_hold_words_one_edit_away(words, half):
    index = spelling.Index(words)
    for m in (6, 7, 8):
        asked = [w for w in words if len(w) == m] + ["z" * m]
        for w, bits in zip(asked, index.near(asked, half), strict=True):
            held = np.unpackbits(bits.view(np.uint8), bitorder="little")[: len(words)]
            shares = lambda v: half and v[:half] == w[:half]  # noqa: B023, E731
            assert [words[i] for i in np.flatnonzero(held)] == [v for v in words if one_edit(v, w) and not shares(v)]


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_gray_order_simhash", "op13_merkle_manifest"])
def test_empty_tables(none, tmp_path, name, llm):
    none.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.queries()[name](llm, str(tmp_path))
    assert found.count() == 0
