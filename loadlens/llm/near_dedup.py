"""Near-duplicate documents by SetSketch registers.

A document's set is its distinct shingles of five words. Texts with equal sets form one class, so
copies are never compared. Each class has a SetSketch: registers that hold exponentially spaced,
truncated minima of the shingles' hashes. Four registers make a band; classes that share a band meet
in a bucket. In a bucket not all pairs are formed: members are held against one centre, the member
that meets most others, and only members that no link joins to the rest are looked at again, at last
with every member of another component; members of a crowded bucket then meet only where they share
one of their rarest shingles, which loses no link. Shingles that no other member has are counted first: a text
with too many of them can link with none, which settles texts that share a mere passage without
forming pairs. The likelihood of the registers rules out hopeless pairs, and what is left is
confirmed on the full sets. Links become components by label propagation.

With 32 bands of four registers a pair at the limit of 0.75 misses all buckets in 5 of a million
cases, closer pairs far more rarely.

A text without words (null, empty, blank) has an empty set and is linked with nothing. Rows with one
id and different texts are different documents; repeated rows are copies. A row with a null id keeps
``component_id`` null if no id is reachable. An empty table gives an empty result. Further columns
are ignored here; ``deduplicated`` keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadlens.llm.common import stored
from loadlens.llm.graph import components, looked_up
from loadlens.llm.tokens import as_bytes, hashed_words, mixed, numbers

SHINGLE = 5
BANDS = 32
ROWS = 4
REGISTERS = BANDS * ROWS
#: Links have 100 * intersection >= SIMILARITY * union.
SIMILARITY = 75
#: Registers are powers of this base, up to LIMIT + 1.
BASE = 1.001
LIMIT = (1 << 16) - 2
RATE = 20.0
#: A pair is ruled out if the best similarity over the limit is this much less likely (natural logarithm) than the best of all.
LOG_RATIO = 12.0
#: Shingles in a block of a bucket's last members, about.
BLOCK = 50_000
#: Last members of more blocks than this meet by their rarest shingles, not block by block.
FEW_BLOCKS = 8
#: Turns with one centre a bucket before the rest is held against each other.
ROUNDS = 1
#: A side of at most this many rows of 40 bytes is sent to all tasks.
BROADCAST_ROWS = 400_000

_FACTORS = numbers(REGISTERS, 4) | np.uint64(1)
_SHIFTS = numbers(REGISTERS, 5)
_PLACES = numbers(SHINGLE, 6) | np.uint64(1)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each text."""
    words, bounds = hashed_words(texts)
    sets = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        own = words[a:b]
        if len(own) >= SHINGLE:
            n = len(own) - SHINGLE + 1
            hashes = own[:n] * _PLACES[0]
            for k in range(1, SHINGLE):
                hashes = hashes + own[k : k + n] * _PLACES[k]
        elif len(own):
            # Fewer words: the whole sequence, told apart from longer ones by its length.
            hashes = (own * _PLACES[: len(own)]).sum(keepdims=True) + numbers(len(own), 7)[-1:]
        else:
            hashes = own
        sets.append(np.unique(mixed(hashes)))
    return sets


def registers(shingles: np.ndarray) -> np.ndarray:
    """The SetSketch of a set that is not empty."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), 2048):
        part = shingles[None, at : at + 2048] * _FACTORS[:, None]
        part += _SHIFTS[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    # A uniform minimum becomes a minimum of exponential values.
    share = (least.astype(np.float64) + 1.0) / 2.0**64
    values = -np.log1p(-np.minimum(share, 1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(values) / np.log(BASE)), 0, LIMIT + 1).astype(np.uint16)


def _sketched(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``class`` (digest of the set, null if empty), ``n_shingles`` and ``sketch``."""

    def sketch(texts: pa.Array) -> pa.Array:
        rows = []
        for shingles in shingle_sets(as_bytes(texts.to_pylist())):
            n = len(shingles)
            rows.append(
                {
                    "class": xxhash.xxh3_128_digest(shingles.tobytes()) if n else None,
                    "n_shingles": n,
                    "sketch": registers(shingles).tobytes() if n else None,
                }
            )
        return pa.array(rows, pa.struct([("class", pa.binary()), ("n_shingles", pa.int64()), ("sketch", pa.binary())]))

    made = F.arrow_udf(sketch, "struct<class:binary,n_shingles:bigint,sketch:binary>")
    more = [c for c in docs.columns if c != "text"]
    return docs.select(*more, made(F.col("text").cast("binary")).alias("s")).select(*more, "s.*")


def likely(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Whether pairs of sketches (rows of registers) may have the wanted similarity, by joint likelihood."""
    more, less = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    equal = REGISTERS - more - less
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    top = np.minimum(u / v, v / u)
    grid = np.linspace(0.0, 1.0, 81)[None, :] * top

    def chance(x: np.ndarray) -> np.ndarray:
        x = np.clip(x, 0.0, 1.0)
        return np.clip(-np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE), 1e-9, 1 - 1e-9)

    def fit(j: np.ndarray) -> np.ndarray:
        up, down = chance(u - v * j), chance(v - u * j)
        same = np.clip(1 - up - down, 1e-9, 1.0)
        return more * np.log(up) + less * np.log(down) + equal * np.log(same)

    limit = np.minimum(SIMILARITY / 100, top)
    over = limit + np.linspace(0.0, 1.0, 41)[None, :] * (top - limit)
    best = fit(over).max(axis=1)
    return best >= np.maximum(fit(grid).max(axis=1), best) - LOG_RATIO


def _possible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (``a`` < ``b``) that sizes and sketches do not rule out."""

    def judge(a: pa.Array, b: pa.Array, n_a: pa.Array, n_b: pa.Array) -> pa.Array:
        if not len(a):
            return pa.array([], pa.bool_())
        rows = [np.frombuffer(b"".join(as_bytes(x.to_pylist())), np.uint16).reshape(-1, REGISTERS) for x in (a, b)]
        sizes = [np.asarray(x.to_pylist(), np.float64) for x in (n_a, n_b)]
        found = [
            likely(rows[0][i : i + 500], rows[1][i : i + 500], sizes[0][i : i + 500], sizes[1][i : i + 500])
            for i in range(0, len(a), 500)
        ]
        return pa.array(np.concatenate(found))

    sides = [
        classes.select(F.col("class").alias(s), F.col("n_shingles").alias(f"n_{s}"), F.col("sketch").alias(f"s_{s}"))
        for s in "ab"
    ]
    joined = pairs.join(sides[0], "a").join(sides[1], "b")
    return joined.filter(F.arrow_udf(judge, "boolean")("s_a", "s_b", "n_a", "n_b")).select("a", "b")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose full sets are similar enough."""

    def judge(a: pa.Array, b: pa.Array) -> pa.Array:
        found = []
        for x, y in zip(as_bytes(a.to_pylist()), as_bytes(b.to_pylist()), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(x) + len(y) - len(np.union1d(x, y))
            found.append(100 * both >= SIMILARITY * (len(x) + len(y) - both))
        return pa.array(found, pa.bool_())

    sides = [sets.select(F.col("class").alias(s), F.col("shingles").alias(f"x_{s}")) for s in "ab"]
    joined = pairs.join(sides[0], "a").join(sides[1], "b")
    return joined.filter(F.arrow_udf(judge, "boolean")("x_a", "x_b")).select("a", "b")


def _sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """The full sets of the classes in ``wanted`` (distinct), from one document of each."""

    def collect(texts: pa.Array) -> pa.Array:
        rows = []
        for shingles in shingle_sets(as_bytes(texts.to_pylist())):
            data = shingles.tobytes()
            rows.append({"class": xxhash.xxh3_128_digest(data), "shingles": data})
        return pa.array(rows, pa.struct([("class", pa.binary()), ("shingles", pa.binary())]))

    wanted = stored(wanted.join(classes.select("class", "label"), "class").select("label").distinct(), "wanted")
    # Ids of 8 bytes: sent to all tasks only while they are few, else a shuffle join.
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    texts = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("label")), "left_semi")
    made = F.arrow_udf(collect, "struct<class:binary,shingles:binary>")
    rows = texts.select(made("text").alias("s")).select("s.*")
    # Repeated rows and other texts of one id: a class once. The set follows from the class.
    return stored(rows.groupBy("class").agg(F.first("shingles").alias("shingles")), "sets")


def _components(links: DataFrame) -> DataFrame:
    """``class`` and ``comp``, the least class reachable, of all classes with links."""
    return components(links).withColumnRenamed("node", "class")


def _members(classes: DataFrame) -> DataFrame:
    """``key``, ``class``, ``n`` and ``met`` (members of the bucket) of all buckets with two members or more."""
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("sketch", 2 * ROWS * i + 1, 2 * ROWS)) for i in range(BANDS)])
    keyed = classes.select("class", F.col("n_shingles").alias("n"), F.explode(keys).alias("key"))
    counts = keyed.groupBy("key").agg(F.count("*").alias("met")).filter("met > 1")
    return stored(keyed.join(counts, "key"), "members")


def _spread(sets: DataFrame) -> DataFrame:
    """``class`` and ``shingle``, a row for each shingle of each class."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(data, np.int64)
                yield pa.RecordBatch.from_arrays([pa.repeat(name, len(own)), pa.array(own)], names=["class", "shingle"])

    return sets.select("class", "shingles").mapInArrow(spread, "class binary, shingle bigint")


def _lone(sets: DataFrame) -> DataFrame:
    """``class`` and ``lone``: how many of its shingles no other class has."""
    once = _spread(sets).groupBy("shingle").agg(F.count("*").alias("n"), F.min("class").alias("class")).filter("n = 1")
    return once.groupBy("class").agg(F.count("*").alias("lone"))


def _ordered(pairs: DataFrame) -> DataFrame:
    """Pairs with the lesser class first, once each, if their sizes allow a link."""
    fits = 100 * F.least("n", "n_centre") >= SIMILARITY * F.greatest("n", "n_centre")
    # No more than this can be in common, and the union is the rest of both.
    common = F.least(F.col("n") - F.col("lone"), F.col("n_centre") - F.col("lone_centre"))
    fits &= 100 * common >= SIMILARITY * (F.col("n") + F.col("n_centre") - common)
    pairs = pairs.filter(fits & (F.col("class") != F.col("centre")) & (F.col("comp") != F.col("comp_centre")))
    return pairs.select(F.least("class", "centre").alias("a"), F.greatest("class", "centre").alias("b")).distinct()


def _unsettled(members: DataFrame) -> DataFrame:
    """Members of the buckets that hold more than one component."""
    keys = members.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi")
    return members.join(keys.select("key"), "key")


def _as_centres(members: DataFrame) -> DataFrame:
    own = ("class", "n", "lone", "comp")
    return members.select("key", *[F.col(c).alias("centre" if c == "class" else f"{c}_centre") for c in own])


def _by_rarest(members: DataFrame, sets: DataFrame) -> DataFrame:
    """``members`` under new keys, so that any two that may link have one in common.

    Two sets that link share one of the rarest ``n - ceil(0.75 n) + 1`` shingles of each, as all rank
    shingles alike: by holders, then by hash. Shingles that the same members hold, those of one
    passage, make one key; the key is a digest of the holders.
    """
    own = stored(members.select("class", "n", "comp").distinct(), "crowded")
    # In halves, so that sums of hashes cannot overflow.
    own_hash = F.xxhash64("class")
    holders = (F.sum(F.shiftright(own_hash, 32)).alias("high"), F.sum(own_hash.bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"))
    rows = stored(_spread(sets.join(own.select("class"), "class", "left_semi")), "spread")
    ranked = rows.groupBy("shingle").agg(F.count("*").alias("held"), *holders).filter("held > 1")
    # Shingles that one member holds are the rarest, and in no link.
    single = own.join(rows.join(ranked.select("shingle"), "shingle").groupBy("class").agg(F.count("*").alias("shared")), "class")
    single = single.withColumn("first", F.col("n") - F.ceil(F.col("n") * SIMILARITY / 100) + 1 - (F.col("n") - F.col("shared")))
    place = F.row_number().over(Window.partitionBy("class").orderBy("held", "shingle"))
    keyed = rows.join(ranked, "shingle").withColumn("place", place).join(single.filter("first > 0"), "class").filter("place <= first")
    return keyed.select(F.xxhash64("held", "high", "low").alias("key"), "class", "n", "comp").distinct()


def _rest(current: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between members of one bucket in different components, found exactly without forming pairs.

    Members of a crowded bucket, one of more than ``FEW_BLOCKS`` blocks, meet under the keys of their
    rarest shingles instead, which gives the same links and those that the bands missed.
    """
    blocks = F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks")
    sized = stored(current.groupBy("key").agg(blocks), "sized")
    crowded = sized.filter(F.col("blocks") > FEW_BLOCKS).select("key")
    found = _met(current.join(sized.filter(F.col("blocks") <= FEW_BLOCKS).select("key"), "key"), sets)
    if crowded.limit(1).count():
        members = stored(_by_rarest(current.join(crowded, "key"), sets), "rarest")
        found = found.union(_met(_unsettled(members), sets))
    return found.distinct()


def _met(current: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between members of one key in different components.

    The members of a key are dealt into blocks of about ``BLOCK`` shingles by hash. Blocks meet two by
    two, each meeting is one row, and products of incidence matrices give all intersections in it.
    """
    blocks = F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks")
    sized = current.groupBy("key").agg(blocks)
    dealt = current.join(sized, "key").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")))
    member = F.struct("class", "comp", "shingles")
    dealt = dealt.join(sets, "class").groupBy("key", "block").agg(F.collect_list(member).alias("members"))
    dealt = stored(dealt, "blocks")
    other = dealt.select("key", F.col("block").alias("block_b"), F.col("members").alias("b"))
    meetings = dealt.join(other, "key").filter("block <= block_b").select(F.col("members").alias("a"), "b")

    def meet(left: pa.Array, right: pa.Array) -> pa.Array:
        rows = []
        for x, y in zip(left, right, strict=True):
            rows.append([{"a": min(p), "b": max(p)} for p in _links_between(x.as_py(), y.as_py())])
        return pa.array(rows, pa.list_(pa.struct([("a", pa.binary()), ("b", pa.binary())])))

    made = stored(meetings.select(F.arrow_udf(meet, "array<struct<a:binary,b:binary>>")("a", "b").alias("l")), "meetings")
    return made.select(F.inline("l")).distinct()


def _links_between(left: list[dict], right: list[dict]) -> Iterator[tuple[bytes, bytes]]:
    """Classes of two blocks in different components whose full sets are similar enough."""
    sides = [[np.frombuffer(m["shingles"], np.uint64) for m in block] for block in (left, right)]
    flat = [np.concatenate(sets) for sets in sides]
    both = np.intersect1d(*flat)
    sizes = [np.array([len(s) for s in sets]) for sets in sides]
    common = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, len(both), 4096):
        part = both[at : at + 4096]
        held = []
        for sets, values in zip(sides, flat, strict=True):
            place = np.minimum(np.searchsorted(part, values), len(part) - 1)
            real = part[place] == values
            owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            matrix = np.zeros((len(sets), len(part)), np.float32)
            matrix[owner[real], place[real]] = 1
            held.append(matrix)
        common += held[0] @ held[1].T
    close = 100 * common >= SIMILARITY * (sizes[0][:, None] + sizes[1][None, :] - common)
    for i, j in np.argwhere(close):
        if left[i]["comp"] != right[j]["comp"]:
            yield left[i]["class"], right[j]["class"]


def links(docs: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Confirmed links between classes, enough to join every component; and the components."""
    spark = docs.sparkSession
    members = _members(classes)
    hubs = members.groupBy("class").agg(F.sum("met").alias("hub"))
    members = members.join(hubs, "class")
    members = stored(members.select("key", "class", "n", "hub", F.lit(0).cast("long").alias("lone")), "members")
    found = spark.createDataFrame([], "a binary, b binary")
    comps = spark.createDataFrame([], "class binary, comp binary")
    sets = None
    best = F.max(F.struct("hub", "n", "lone", "class", "comp")).alias("best")
    for turn in range(ROUNDS + 1):
        named = members.join(comps, "class", "left").withColumn("comp", F.coalesce("comp", "class"))
        current = stored(_unsettled(named), "unsettled")
        if turn == 1:
            # Shingles that no other unsettled class has are in no link, so many of them rule a class out.
            sets = _sets(docs, classes, current.select("class").distinct())
            current = current.drop("lone").join(_lone(sets), "class", "left").fillna({"lone": 0})
            current = current.filter(100 * (F.col("n") - F.col("lone")) >= SIMILARITY * F.col("n"))
            current = stored(_unsettled(current), "unsettled")
            members = current.drop("comp")
        if current.limit(1).count() == 0:
            break
        if turn == ROUNDS:
            found = found.union(stored(_rest(current, sets), "links"))
            comps = _components(found)
            break
        # The centre is the member that meets most others; in later turns one outside the first centre's component.
        centres = current.groupBy("key").agg(best).select("key", "best.*")
        if turn:
            first = centres.select("key", F.col("comp").alias("first"))
            rest = current.join(first, "key").filter("comp <> first")
            centres = rest.groupBy("key").agg(best).select("key", "best.*")
        pairs = current.join(_as_centres(centres), "key")
        possible = stored(_possible(_ordered(pairs), classes), "possible")
        if possible.limit(1).count():
            wanted = possible.select(F.explode(F.array("a", "b")).alias("class")).distinct()
            full = sets if turn else _sets(docs, classes, wanted)
            found = found.union(stored(_confirmed(possible, full), "links"))
            comps = _components(found)
    return found, comps


def membership(docs: DataFrame) -> DataFrame:
    """``docs`` without text, with ``n_shingles``, ``class``, ``comp`` (least class of the component) and ``component_id``."""
    own = stored(_sketched(docs), "sketches")
    whole = own.filter(F.col("class").isNotNull())
    classes = whole.groupBy("class").agg(
        F.min("doc_id").alias("label"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")
    )
    classes = stored(classes, "classes")
    _, comps = links(docs, classes)
    linked = stored(classes.select("class", "label").join(comps, "class"), "linked")
    least = linked.groupBy("comp").agg(F.min("label").alias("component_id"))
    linked = looked_up(linked, "comp", least, F.col("class")).select("class", "comp", "component_id")
    # A class without links is a component of its own.
    alone = F.col("comp").isNull()
    named = classes.select("class", "label").join(linked, "class", "left").select(
        F.col("class").alias("_class"), F.coalesce("comp", "class").alias("comp"),
        F.when(alone, F.col("label")).otherwise(F.col("component_id")).alias("component_id"),
    )
    more = [c for c in docs.columns if c != "text"]
    joined = own.drop("sketch").join(named, F.col("class") == F.col("_class"), "left")
    lone = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select(*more, "n_shingles", "class", "comp", lone.alias("component_id"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component. All columns stay.

    The row with the least id stays; of several texts with that id the one with the least hash, of
    repeated rows one, told by a hash of the other columns. Rows without an id go where one with an id
    stays. Rows without words are linked with nothing and stay.
    """
    digest = F.xxhash64("text").alias("digest")
    found = membership(docs.select("doc_id", digest, "text")).filter(F.col("comp").isNotNull())
    rows = found.groupBy("comp", "doc_id", "digest").agg(F.count("*").alias("n"))
    rows = stored(rows.withColumn("order", F.struct(F.col("doc_id").isNull(), "doc_id", "digest")), "fates")
    stays = rows.groupBy("comp").agg(F.min("order").alias("least"))
    fates = looked_up(rows, "comp", stays, F.col("digest")).withColumn("goes", F.col("order") != F.col("least"))
    fates = stored(fates.select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"), "goes", "n"), "fates")

    # By frame, for docs may have columns of the same names.
    def same(other: DataFrame) -> Column:
        return docs["doc_id"].eqNullSafe(other["__id"]) & (F.xxhash64(docs["text"]) == other["__digest"])

    changed = fates.filter("goes or n > 1").select("__id", "__digest")
    whole = docs.join(changed, same(changed), "left_anti")
    repeated = fates.filter("not goes and n > 1").select("__id", "__digest")
    others = [docs[c] for c in docs.columns if c not in ("doc_id", "text")]
    one = docs.join(repeated, same(repeated)).select(
        "__id", "__digest", F.struct(*[docs[c] for c in docs.columns]).alias("__row"),
        F.xxhash64(F.to_json(F.struct(F.lit(0).alias("_"), *others))).alias("__order"),
    )
    one = one.groupBy("__id", "__digest").agg(F.min_by("__row", "__order").alias("__row"))
    return whole.unionByName(one.select("__row.*"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Components of all documents, in the columns of the contract."""
    found = membership(docs.select("doc_id", "text"))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return found.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))
