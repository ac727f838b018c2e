"""Operators against plain versions on odd cases: sharding, rules, personal data, packing, near duplicates."""

from __future__ import annotations

import re
import time
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import prose

from loadlens.llm import near_dedup, packing, pii, quality_rules, sharding, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def pairs(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def test_words_are_hashed_alike_in_any_cut(monkeypatch):
    texts = [b"One two  three\n", b"", b"four", b"x" * 3000 + b" y", "é è".encode()]
    words, bounds = tokens.hashed_words(texts)
    assert list(np.diff(bounds)) == [len(t.split()) for t in texts]
    monkeypatch.setattr(tokens, "SLICE", 7)
    again, bounds_again = tokens.hashed_words(texts)
    assert (words == again).all() and (bounds == bounds_again).all()


def test_shards_are_whole_and_even(docs):
    got = sharding.placed(docs).collect()
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in pairs(docs))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    by_shard = Counter(r["shard"] for r in got)
    counts = [by_shard.get(s, 0) for s in range(sharding.SHARDS)]
    assert max(counts) - min(counts) <= 1
    for s, n in by_shard.items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n))


def test_shards_keep_columns_order_changes_with_seed(docs, tmp_path):
    own = docs.withColumn("size", F.lit(10).cast("long"))
    one = sharding.shuffled(own, "size", shards=3, seed=1)
    assert set(own.columns) == set(one.columns)
    orders = [[r["doc_id"] for r in sharding.shuffled(own, "size", shards=1, seed=s).orderBy("slot").collect()] for s in (1, 1, 2)]
    assert orders[0] == orders[1] != orders[2]
    sharding.write_shards(own, str(tmp_path / "shards"), "size", shards=3)
    assert docs.sparkSession.read.parquet(str(tmp_path / "shards")).count() == own.count()


def test_placed_rows_are_those_of_whole_written_shards(docs, monkeypatch):
    paths, write = [], sharding.write_shards
    monkeypatch.setattr(sharding, "write_shards", lambda rows, path, size: (paths.append(path), write(rows, path, size)))
    got = sharding.placed(docs).collect()
    files = docs.sparkSession.read.parquet(*paths)
    assert set(files.columns) == set(docs.columns)
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    assert Counter(files.select(kept).collect()) == Counter(docs.select(kept).collect())
    written = [(r["shard"], r["slot"], r["doc_id"], zlib.crc32((r["text"] or "").encode())) for r in files.collect()]
    assert Counter(written) == Counter((r["shard"], r["slot"], r["doc_id"], r["text_crc32"]) for r in got)


def test_rules_count_as_a_plain_loop_does(docs):
    def plain(text):
        words = WORD.findall(text or "")
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        seen = Counter(windows)
        covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
        lines = [line for line in (text or "").split("\n") if WORD.search(line)]
        return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))

    got = quality_rules.judged(docs).collect()
    want = Counter((i, *plain(t)) for i, t in pairs(docs))
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])


def test_rules_drop_foreign_looking_text(llm):
    rows = [(i, "the of and to in " + " of the ".join(prose(i, 60).split()) + ".", "en") for i in range(30)]
    rows.append((99, " ".join(f"X{i}Y!!" for i in range(100)), "en"))
    got = {r["doc_id"]: r for r in quality_rules.measured(llm.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[99]["char_distance"] > quality_rules.MAX_CHAR_DISTANCE > max(got[i]["char_distance"] for i in range(30))


def test_plain_personal_data_is_leftmost_and_whole():
    text = "a@b@c.de.f x@y 1.2.3.4.5 300.1.1.1 x 4111 1111 1111-1111 x 4111 1111 1111 1112 x +1 (930) 555-2361 +12"
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", pii._card),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.findall("[0-9]", s)) <= 15),
    }
    want = [(k, *m.span()) for k, (p, ok) in kinds.items() for m in re.finditer(p, text) if ok(m[0])]
    assert pii.plain_spans(text) == want and {k for k, *_ in want} == set(kinds)


@pytest.mark.parametrize(
    ("text", "kind", "hidden"),
    [
        ("write to bob (dot) smith [at] exаmple (dot) com please", "email", "bob (dot) smith [at] exаmple (dot) com"),
        ("or j.doe at foo dot org now", "email", "j.doe at foo dot org"),
        ("call plus one two three four five six seven eight nine zero now", "phone", "plus one two three four five six seven eight nine zero"),
        ("host ２０３.0.113.9 up", "ip", "２０３.0.113.9"),
        ("bo​b@ex­ample.com", "email", "bo​b@ex­ample.com"),
        ("plus 49 30 1234 567 eight nine.", "phone", "plus 49 30 1234 567 eight nine"),
        ("ping 192 dot 168 dot 1 dot 10 again", "ip", "192 dot 168 dot 1 dot 10"),
        ("bob at example dot ai", "email", "bob at example dot ai"),
    ],
)
def test_disguised_data_maps_back_to_the_source(text, kind, hidden):
    added = [(k, text[s:e]) for k, s, e, plain in pii.all_spans(text) if not plain]
    assert added == [(kind, hidden)]
    assert hidden not in pii.masked_text(text) and f"<{kind}>" in pii.masked_text(text)


def test_common_words_are_no_disguise():
    assert pii.all_spans("we met at home and looked at the dot on one of two or three maps at noon") == []
    assert pii.all_spans("he arrived at this point in time and looked at a dot in it") == []


def test_spans_among_very_many_addresses_take_no_pairwise_look():
    text = " ".join(f"user{i}@host{i}.com" for i in range(8000)) + " bob [at] x [dot] org"
    began = time.perf_counter()
    found = pii.all_spans(text)
    assert len(found) == 8001 and [text[s:e] for _, s, e, plain in found if not plain] == ["bob [at] x [dot] org"]
    assert time.perf_counter() - began < 3


def test_personal_data_query(docs):
    extra = docs.withColumn("text", F.when(F.col("doc_id") == 33, "mail a@b.cd or c (at) d.ef").otherwise(F.col("text")))
    got = pii.found(extra).collect()
    assert len(got) == docs.count()
    row = next(r for r in got if r["doc_id"] == 33)
    assert (row["n_email"], row["n_added"], row["spans"]) == (1, 1, "email:5:11,email:15:26")
    assert row["base_sha256"] == sha256(b"email:5:11").hexdigest()
    assert all(r["spans"] == "" for r in got if r["doc_id"] in (30, 31, 32))


def test_fast_ids_are_the_ids_of_the_file():
    safe = [chr(c) for c in range(0x250) if not packing._OTHER.search(chr(c))]
    for c in safe:
        for text in (c, f"a{c}", f"{c}a", f" {c}", f"1{c}1", f"{c}{c} {c}", f"a {c}b\n{c}", f"'{c}s {c}'ll", f"!{c}?", f"  {c}  "):
            assert packing.ids_of(text).tolist() == [*packing._whole("byte_bpe_50k").encode(text, add_special_tokens=False).ids, 0]


def test_cuts_are_powers_of_two_and_cover_all():
    for n in [*range(1, 300), 1023, 1024, 1025, 4097]:
        got = packing.cut(n, 64)
        assert [s for s, _ in got] == list(np.cumsum([0, *[k for _, k in got]])[:-1]) and sum(k for _, k in got) == n
        assert all(k & (k - 1) == 0 and k <= 64 for _, k in got)
        assert sum(k < 64 for _, k in got) == bin(n % 64).count("1")


def test_pieces_hold_every_id_once(docs):
    got = packing.pieces(docs).collect()
    want = Counter((i, tuple(packing.ids_of(t or "").tolist())) for i, t in pairs(docs))
    assert len({r["sequence_id"] for r in got}) == len(got)
    whole, parts = Counter(), {}
    for r in sorted(got, key=lambda r: (r["doc_tokens"], r["start"])):
        assert r["length"] == len(r["ids"]) and r["offset"] == 0
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], np.uint32).tobytes())
        parts.setdefault(r["doc_tokens"], 0)
        parts[r["doc_tokens"]] += r["length"]
        whole[r["doc_id"], r["start"], tuple(r["ids"])] += 1
    cut_plainly = Counter()
    for (i, ids), n in want.items():
        for s, k in packing.cut(len(ids)):
            cut_plainly[i, s, ids[s : s + k]] += n
    assert whole == cut_plainly


def components_plainly(rows):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                up[top(i)] = top(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[top(i)] = min(key, least.get(top(i), key))
    return Counter((rows[i][0], len(sets[i]), least.get(top(i)) if sets[i] else rows[i][0]) for i in range(len(rows)))


def test_near_duplicates_as_plain_comparison(docs):
    got = near_dedup.near_duplicates(docs).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == components_plainly(pairs(docs))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


@pytest.mark.parametrize("crowded", [False, True])
def test_large_groups_need_all_turns(llm, monkeypatch, crowded):
    """Chains and a group around one text, where the centre of a bucket links only some members."""
    if crowded:  # all last members meet by their rarest shingles
        monkeypatch.setattr(near_dedup, "FEW_BLOCKS", 0)
    words = prose(50, 120).split()
    rows, k = [], 0
    for step in range(40):
        own = list(words)
        own[(7 * step) % 120] = f"new{step}"
        if step % 3 == 0:
            for j in range(0, 60, 20):
                own[(11 * step + j) % 120] = f"more{step}x{j}"
        rows.append((k := k + 1, " ".join(own)))
    shared = " ".join(prose(51, 40).split())
    rows += [(1000 + i, shared + " " + prose(2000 + i, 60)) for i in range(60)]
    got = near_dedup.near_duplicates(llm.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == components_plainly(rows)


def test_blocks_find_what_single_pairs_do():
    draw = np.random.default_rng(1)
    base = np.unique(draw.integers(0, 1 << 40, 300).astype(np.uint64))
    members = []
    for i in range(12):
        own = np.unique(np.concatenate([draw.permutation(base)[: 290 - 3 * i], draw.integers(0, 1 << 40, 5).astype(np.uint64)]))
        members.append({"class": bytes([i]), "comp": bytes([i % 5]), "shingles": own.tobytes()})
    got = set(near_dedup._links_between(members[:6], members[6:]))
    sets = [set(np.frombuffer(m["shingles"], np.uint64).tolist()) for m in members]
    want = {
        (bytes([i]), bytes([j]))
        for i in range(6) for j in range(6, 12)
        if i % 5 != j % 5 and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])
    }
    assert got == want and want


def test_a_crowded_bucket_meets_by_rarest_shingles(llm, monkeypatch):
    """3000 sets with 70 of 100 shingles in common: families of three link, and few others meet."""
    draw = np.random.default_rng(2)
    shared = draw.integers(0, 1 << 62, 70)
    rows, links = [], set()
    for family in range(1000):
        own = draw.integers(0, 1 << 62, 28)
        names = [f"{3 * family + k:08d}".encode() for k in range(3)]
        for name in names:
            members = np.unique(np.concatenate([shared, own, draw.integers(0, 1 << 62, 2)])).astype(np.uint64)
            rows.append((bytearray(name), 100, bytearray(name), bytearray(members.tobytes())))
        links |= {(names[a], names[b]) for a, b in ((0, 1), (0, 2), (1, 2))}
    table = llm.createDataFrame(rows, "class binary, n long, comp binary, shingles binary")
    sets = near_dedup.stored(table.select("class", "shingles"), "sets")
    current = near_dedup.stored(table.select(F.lit(1).cast("long").alias("key"), "class", "n", F.lit(0).cast("long").alias("lone"), "comp"), "current")
    monkeypatch.setattr(near_dedup, "BLOCK", 20_000)
    assert {(bytes(r["a"]), bytes(r["b"])) for r in near_dedup._rest(current, sets).collect()} == links
    keys = near_dedup._by_rarest(current, sets).groupBy("key").count().collect()
    assert sum(r["count"] * (r["count"] - 1) // 2 for r in keys) < 10 * len(links)


def test_deduplicated_keeps_one_of_each_and_all_columns(docs):
    got = near_dedup.deduplicated(docs)
    assert got.columns == docs.columns
    ids = Counter(r["doc_id"] for r in got.collect())
    assert ids[20] == 1 and not {21, 22, 23, 35, 36} & set(ids) and {30, 31, 32, 33, 34} <= set(ids)
    assert ids[None] == 1  # the copy goes, the row without words stays


def test_one_of_repeated_rows_stays(llm):
    """Five rows alike, copies without an id, one with another id; texts that share an id; a group without ids."""
    t, u, v = prose(71, 40), prose(72, 40), prose(73, 40)
    rows = [(1, t, 7)] * 5 + [(None, t, 7)] * 2 + [(2, t, 7), (3, u, 1), (3, u + " more", 2), (None, v, 1), (None, v, 2), (4, prose(74, 40), 9)]
    table = llm.createDataFrame(rows, "doc_id long, text string, __row long").repartition(3)
    got = near_dedup.deduplicated(table)
    assert got.columns == table.columns
    found = Counter(r["doc_id"] for r in got.collect())
    assert found == {1: 1, 3: 1, None: 1, 4: 1}
    assert sorted(map(str, got.collect())) == sorted(map(str, near_dedup.deduplicated(table.repartition(5)).collect()))


@pytest.mark.parametrize("query", [sharding.placed, quality_rules.judged, pii.found, packing.packed, near_dedup.near_duplicates, near_dedup.deduplicated])
def test_empty_tables(none, query):
    assert query(none).count() == 0
