"""Check SQL for DuckDB of the queries that SQL expresses plainly."""

from __future__ import annotations

_CAPITALS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

#: The table of the reflected polynomial 0xEDB88320, which ``crc32`` uses.
_CRC_TABLE = """
    select list_transform(range(256), lambda b: list_reduce(range(8),
        lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, b)) t"""


def _crc32(codes: str) -> str:
    """``crc32`` of a list of bytes, given the table as ``t``."""
    return f"xor(list_reduce({codes}, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295)"


def _field(value: str) -> str:
    return f"coalesce(strlen(cast({value} as varchar)) || ':' || cast({value} as varchar), '-')"


def _climb(name: str, base: str) -> str:
    """All nodes of the trees in ``base`` (``tree``, ``place``, ``total``, ``h``) and their runs of 16."""
    return f"""
    {name}_nodes as (
        select tree, 0 lvl, place, total, h from {base}
        union all
        select tree, lvl + 1, place // 16, (total + 15) // 16, sha256(string_agg(h, '' order by place))
        from {name}_nodes where total > 1 group by tree, lvl, place // 16, total),
    {name}_runs as (
        select tree, lvl, place // 16 run, list(h order by place) hs from {name}_nodes where total > 1
        group by tree, lvl, place // 16)"""


def _walk(name: str, base: str) -> str:
    """From nodes in ``base`` (``id``, ``tree``, ``place``, ``cur``, ``sib``) to the root: ``cur`` folded, ``sib`` all siblings."""
    left, right = "array_to_string(r.hs[1:w.place % 16], '')", "array_to_string(r.hs[w.place % 16 + 2:], '')"
    return f"""
    {name}_steps as (
        select id, tree, 0 lvl, place, cur, sib from {base}
        union all
        select w.id, w.tree, w.lvl + 1, w.place // 16, sha256({left} || w.cur || {right}), w.sib || {left} || {right}
        from {name}_steps w join {name}_runs r on r.tree = w.tree and r.lvl = w.lvl and r.run = w.place // 16),
    {name}_ends as (select id, arg_max(cur, lvl) cur, arg_max(sib, lvl) sib from {name}_steps group by id)"""


_LEAF = " || ".join(_field(f) for f in ("doc_id", "source", "lang", "n_chars"))

#: Nodes level by level with a row a node, then every leaf walks up through its runs.
MERKLE = f"""
    with recursive crc as ({_CRC_TABLE}),
    leaves as (
        select row_number() over () id, doc_id, source, {_field("source")} tree, sha256({_LEAF} || {_field("text")}) leaf,
            case when {_crc32("list_transform(string_split(cast(doc_id as varchar), ''), lambda d: ascii(d))")} % 5 = 0
                then sha256({_LEAF} || {_field(f"translate(text, {_CAPITALS})")}) end changed
        from documents, crc),
    placed as (
        select *, leaf h, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 place,
            count(*) over (partition by tree) total
        from leaves),
    {_climb("sub", "placed")},
    tops as (select tree, h from sub_nodes where total = 1),
    names as (select distinct tree, source from leaves),
    sources as (
        select '' tree, n.tree name, t.h, row_number() over (order by encode(n.source) nulls first) - 1 place, count(*) over () total
        from names n join tops t on t.tree = n.tree),
    {_climb("all", "sources")},
    {_walk("sub", "(select id, tree, place, coalesce(changed, leaf) cur, '' sib from placed)")},
    {_walk("all", "(select p.id, '' tree, s.place, e.cur, e.sib from placed p join sources s on s.name = p.tree join sub_ends e on e.id = p.id)")}
    select p.doc_id, p.leaf, t.h subroot, r.h root, sha256(e.sib) proof_sha256, e.cur folded_root, e.cur = r.h verified
    from placed p join tops t on t.tree = p.tree join all_ends e on e.id = p.id
    cross join (select h from all_nodes where total = 1) r"""

_CODES = """flatten(list_transform(string_split(cast(doc_id as varchar) || ':' || run, ''),
    lambda c: case when unicode(c) < 128 then [unicode(c)] else [195, unicode(c) - 64] end))"""

#: Near words by their spellings with one code point left out.
SPELLING = f"""
    with recursive crc as ({_CRC_TABLE}),
    runs as (
        select doc_id, unnest(regexp_extract_all(translate(text, {_CAPITALS}), '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) run
        from documents),
    hashed as (select run, {_crc32(_CODES)} h from runs, crc where length(run) >= 6),
    cut as (
        select case when h % 199 = 0 then left(run, cast(h % length(run) as int)) || substr(run, cast(h % length(run) as int) + 2)
            else run end word
        from hashed),
    words as (select word, count(*) n from cut where length(word) >= 6 group by word having count(*) >= 5),
    places as (select word, unnest(range(cast(length(word) as int))) k from words),
    without as (select word, k, left(word, cast(k as int)) || substr(word, cast(k as int) + 2) rest from places),
    pairs as (
        select a.word, b.word other from without a join without b on a.k = b.k and a.rest = b.rest and a.word <> b.word
        union select w.word, v.word from without w join words v on v.word = w.rest
        union select v.word, w.word from without w join words v on v.word = w.rest),
    ranked as (
        select p.word, p.other, o.n other_n, count(*) over (partition by p.word) n_near,
            row_number() over (partition by p.word order by o.n desc, encode(p.other)) k
        from pairs p join words o on o.word = p.other),
    formed as (
        select w.word, w.n, coalesce(r.n_near, 0) n_near,
            case when r.other_n >= 5 * w.n then r.other end form, case when r.other_n >= 5 * w.n then r.other_n end form_n
        from words w left join ranked r on r.word = w.word and r.k = 1),
    ways as (
        select word, word root, 0 steps from formed
        union all
        select y.word, f.form, y.steps + 1 from ways y join formed f on f.word = y.root where f.form is not null)
    select f.word, f.form, y.root, f.n, f.n_near, f.form_n
    from formed f join (select word, arg_max(root, steps) root from ways group by word) y on y.word = f.word"""


def _distance(p: str, q: str) -> str:
    """Jensen-Shannon distance of two lists of counts; null where one is empty."""
    x, y = f"(x / list_sum({p}))", f"({q}[i] / list_sum({q}))"
    parts = f"case when {x} > 0 then {x} * log2(2 * {x} / ({x} + {y})) else 0 end + case when {y} > 0 then {y} * log2(2 * {y} / ({x} + {y})) else 0 end"
    return f"case when list_sum({p}) > 0 and list_sum({q}) > 0 then sqrt(greatest(list_sum(list_transform({p}, lambda x, i: {parts})) / 2, 0)) end"


def divergence(
    common_words: dict[str, str], kinds: tuple[str, ...], least: int, judged: int, common: int,
    char: float, word: float, cover: float,
) -> str:
    """Base figures by listing words, windows and lines; distances from sums over the languages."""
    lists = {name: "[" + ", ".join(f"'{w}'" for w in words.split()) + "]" for name, words in common_words.items()}
    widest = max(len(w.split()) for w in common_words.values())
    known = "case tongue " + " ".join(f"when '{n}' then {words}" for n, words in lists.items()) + " end"
    hits = {n: f"len(list_filter(letters, lambda x: list_contains({words}, x)))" for n, words in lists.items()}
    most = f"greatest({', '.join(hits.values())})"
    guess = "case " + " ".join(f"when {h} = {most} then '{n}'" for n, h in hits.items()) + " end"
    removed = [f"""length(t) - length(regexp_replace(t, '{k.replace("'", "''")}', '', 'g'))""" for k in kinds]
    chars = ", ".join([*removed, "length(t) - word_chars", "n_symbols"])
    sums = lambda c, n: "[" + ", ".join(f"sum({c}[{i}])" for i in range(1, n + 1)) + "]"
    n_chars = len(kinds) + 3
    return f"""
    with texts as (
        select row_number() over () id, doc_id, lang, coalesce(text, '') t,
            regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') w,
            regexp_extract_all(lower(coalesce(text, '')), '\\p{{L}}+') letters
        from documents),
    windows as (select id, unnest(range(1, len(w) - 1)) i, w from texts),
    twice as (
        select id, i from (
            select id, i, count(*) over (partition by id, [w[i], w[i + 1], w[i + 2]]) c from windows) where c > 1),
    repeated as (
        select id, count(distinct k) n from (select id, unnest([i, i + 1, i + 2]) k from twice) group by id),
    lines as (
        select id, len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))) n,
            len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))) d
        from texts),
    base as (
        select x.*, len(w) n_words, cast(list_sum(list_transform(w, lambda v: length(v))) as bigint) word_chars,
            length(t) - length(translate(t, '#*$%&|<>', '')) n_symbols, l.n - l.d n_dup_lines, coalesce(r.n, 0) n_repeat_words
        from texts x join lines l using (id) left join repeated r using (id)),
    counted as (
        select * replace (coalesce(word_chars, 0) as word_chars),
            n_words < {least} or 100 * n_repeat_words > 50 * n_words base_failed,
            case when lang is null then {guess} when lang in ({", ".join(f"'{n}'" for n in lists)}) then lang end tongue
        from base),
    kinds as (select *, [{chars}] c0, {known} listed from counted),
    histograms as (
        select *, list_transform(c0, lambda x: x - 0) || [length(t) - list_sum(c0)] chars,
            list_transform(listed, lambda v: len(list_filter(letters, lambda x: x = v))) hist,
            case when listed is not null then [len(list_filter(letters, lambda x: list_contains(listed, x))),
                len(list_filter(letters, lambda x: not list_contains(listed, x)))] end cover
        from kinds),
    refs as (
        select tongue, {sums("chars", n_chars)} chars, {sums("hist", widest)} hist, {sums("cover", 2)} cover
        from histograms where not base_failed group by tongue),
    whole as (select {sums("chars", n_chars)} chars from histograms where not base_failed),
    measured as (
        select h.*, {_distance("h.chars", "coalesce(case when h.tongue is null then a.chars end, r.chars)")} cd,
            {_distance("h.hist", "list_filter(r.hist, lambda z: z is not null)")} wd, {_distance("h.cover", "r.cover")} vd,
            {_distance("[0, 1]", "r.cover")} bare
        from histograms h cross join whole a left join refs r on r.tongue = h.tongue)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
        not base_failed and not coalesce(cd > {char} or (cover[1] >= {common} and wd > {word})
            or (cover[1] + cover[2] >= {judged} and vd > {cover} * bare), false) kept
    from measured"""
