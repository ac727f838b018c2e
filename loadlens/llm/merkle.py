"""A Merkle tree over the rows of a dataset, in DataFrame functions only.

Each row is a leaf, the digest of its fields. The leaves of a source, in the order of ``doc_id``, form
its subtree; the subroots, in the order of the sources, form the tree. A node is the digest of
``ARITY`` consecutive nodes below it; only the last node of a level may have fewer.

Leaves are dealt into aligned blocks of ``BLOCK``, so no node below a block's top reaches into another
block. A block keeps each of its levels as one string of hex digits: parents hash substrings of a
fixed width, and what lies left and right of a node in its substring are its siblings. The tops of
all blocks are the leaves of the next, ``BLOCK`` times smaller tree, which is climbed in the same way
until one block is left.

Places in a source come from a sort by range over all rows, whose keys are split further by digest
and place, so neither a hot source nor a repeated row gathers in one task.

Null fields are told apart from empty ones. Rows without an id come first in their source; rows with
one id are ordered by digest, and equal rows take neighbouring places. Sources without a name come
first. A leaf that is alone is its source's subroot, and a source that is alone is the root. An empty
table gives an empty result. Further columns are ignored, whatever their names; a very long text is
hashed whole where it lies and never moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadlens.llm.common import fold_of, stored

ARITY = 16
#: Levels of a block, and its leaves.
LEVELS = 2
BLOCK = ARITY**LEVELS
#: Hex digits of a digest.
WIDTH = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: One document in so many is tampered with to test that its proof fails.
TAMPERED_OF = 5

_FLANKS = "array<struct<left:string,right:string>>"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of texts, concatenated."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """A value as its UTF-8 size, a colon and the value as text; a dash if null."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_of(**other: Column) -> Column:
    """The digest of a row's fields, some of them replaced."""
    return digest(*[field(other.get(name, F.col(name))) for name in FIELDS])


def _placed(rows: DataFrame, tree: str, order: list[Column], name: str) -> DataFrame:
    """``rows`` with ``at`` (from 0, in the order of ``tree`` and ``order``) and ``total`` of their tree, stored.

    A sort by range, then counts a task and tree: a tree's rows lie in few consecutive tasks.
    """
    keys = [F.col(tree).asc_nulls_first(), *order]
    # Equal rows are split by their place in the input.
    rows = rows.withColumn("spread", F.xxhash64(F.monotonically_increasing_id()))
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    done = rows.repartitionByRange(width, *keys, "spread").sortWithinPartitions(*keys, "spread").drop("spread")
    done = stored(done.withColumn("row", F.monotonically_increasing_id()), name)
    part = F.shiftright("row", 33).alias("part")
    parts = done.groupBy(part, tree).agg(F.count("*").alias("n"), F.min("row").alias("first"))
    of_tree = Window.partitionBy(tree)
    before = of_tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        F.col("part").alias("_part"), F.col(tree).alias("_tree"), "first",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(of_tree).alias("total"),
    )
    # Both sides by task and tree: a task's share of a tree is bounded by the sort.
    same = (F.shiftright("row", 33) == F.col("_part")) & F.col(tree).eqNullSafe(F.col("_tree"))
    at = (F.col("row") - F.col("first") + F.col("before")).alias("at")
    return done.join(parts, same).select(*rows.drop("spread").columns, at, "total")


def _piece(level: str, run: Column) -> Column:
    """The hex digits of one run of a level; bytes, so that no characters are counted to find it."""
    return F.substring(level, run * (ARITY * WIDTH) + 1, F.lit(ARITY * WIDTH)).cast("string")


def _flank(piece: Column, place: Column) -> Column:
    """What lies left and right of a node in the digits of its run."""
    left = F.substring(piece, F.lit(1), place * WIDTH)
    right = F.substring(piece, place * WIDTH + WIDTH + 1, F.lit(ARITY * WIDTH))
    return F.struct(left.alias("left"), right.alias("right"))


def _parents(level: str) -> Column:
    """The next level: the digests of all runs."""
    runs = F.sequence(F.lit(0), F.ceil(F.octet_length(level) / (ARITY * WIDTH)).cast("int") - 1)
    return F.array_join(F.transform(runs, lambda j: digest(_piece(level, j))), "").cast("binary")


def _blocks(nodes: DataFrame, kept: list[str], name: str) -> DataFrame:
    """Aligned blocks: ``items`` (``node`` and ``kept`` columns in order), the block's levels as hex strings, its ``top``.

    A block climbs only while its tree has more than one node, so a small tree ends inside its block.
    """
    item = F.struct("at", "node", *kept)
    blocks = nodes.groupBy("tree", "total", F.expr(f"at div {BLOCK}").alias("block")).agg(
        F.array_sort(F.collect_list(item)).alias("items")
    )
    blocks = stored(blocks, name)
    blocks = blocks.withColumn("level0", F.array_join(F.col("items.node"), "").cast("binary"))
    for k in range(LEVELS):
        blocks = blocks.withColumn(f"level{k + 1}", F.when(F.col("total") > ARITY**k, _parents(f"level{k}")))
    tops = [F.when(F.col("total") <= ARITY**k, F.col(f"level{k}")) for k in range(LEVELS)]
    return blocks.withColumn("top", F.coalesce(*tops, F.col(f"level{LEVELS}")).cast("string"))


def climbed(nodes: DataFrame, kept: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """The blocks of all nodes, and ``tree``, ``block``, ``above`` and ``top`` of each block.

    ``nodes`` has ``tree``, ``at`` (gapless from 0 in the tree), ``total`` (nodes of the tree) and
    ``node``. ``above`` holds the siblings left and right on the way from the block's top to the
    tree's root ``top``. What is kept must be small: it is gathered by block.
    """
    blocks = _blocks(nodes, kept, f"{name}-blocks")
    peaks = stored(blocks.select("tree", "block", "total", F.col("top").alias("node")), f"{name}-tops")
    if not peaks.filter(F.col("total") > BLOCK).limit(1).count():
        return blocks, peaks.select("tree", "block", F.array().cast(_FLANKS).alias("above"), F.col("node").alias("top"))
    total = F.ceil(F.col("total") / BLOCK).cast("long").alias("total")
    higher = climbed(peaks.select("tree", F.col("block").alias("at"), total, "node"), [], name)
    return blocks, expanded(*higher, []).select("tree", F.col("at").alias("block"), F.col("path").alias("above"), "top")


def expanded(blocks: DataFrame, tops: DataFrame, kept: list[str]) -> DataFrame:
    """``tree``, ``at``, ``node``, the ``kept`` columns, ``path`` (all siblings) and further columns of ``tops``.

    First a row a run, with its own digits only, then a row a node: no node carries a whole level.
    """
    further = [c for c in tops.columns if c not in ("tree", "block", "above")]
    joined = blocks.drop("top").join(tops, ["tree", "block"])

    def run(j: Column) -> Column:
        inner = []
        for k in range(1, LEVELS):
            place = F.floor(j / ARITY ** (k - 1)).cast("int")
            flank = _flank(_piece(f"level{k}", F.floor(place / ARITY).cast("int")), place % ARITY)
            inner.append(F.when(F.col("total") > ARITY**k, flank))
        over = F.concat(F.filter(F.array(*inner), lambda x: x.isNotNull()), F.col("above"))
        own = F.slice("items", j * ARITY + 1, F.lit(ARITY))
        return F.struct(own.alias("own"), _piece("level0", j).alias("piece"), over.alias("over"))

    places = F.sequence(F.lit(0), F.ceil(F.size("items") / ARITY).cast("int") - 1)
    runs = joined.select("tree", "total", *further, F.explode(F.transform(places, run)).alias("run"))
    single = runs.select(
        "tree", "total", *further, F.col("run.piece").alias("piece"), F.col("run.over").alias("over"),
        F.posexplode("run.own").alias("place", "item"),
    )
    first = F.when(F.col("total") > 1, F.array(_flank(F.col("piece"), F.col("place")))).otherwise(F.array().cast(_FLANKS))
    return single.select(
        "tree", *[F.col(f"item.{c}").alias(c) for c in ("at", "node", *kept)],
        F.concat(first, F.col("over")).alias("path"), *further,
    )


def proof_of(path: str) -> Column:
    """The digest of all siblings, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def folded(leaf: Column, path: str) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, leaf, lambda node, s: digest(s["left"], node, s["right"]))


def manifest(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``leaf``, ``changed`` (the leaf of a tampered row, else null), ``subroot``, ``root`` and ``path``.

    ``path`` holds the siblings from the leaf up to the root.
    """
    lowered = F.translate("text", _CAPITALS, _CAPITALS.lower())
    tampered = F.when(fold_of("doc_id", TAMPERED_OF) == 0, leaf_of(text=lowered))
    leaves = docs.select(field(F.col("source")).alias("tree"), "doc_id", leaf_of().alias("node"), tampered.alias("changed"))
    leaves = _placed(leaves, "tree", [F.col("doc_id").asc_nulls_first(), F.col("node").asc()], "leaves")
    blocks, tops = climbed(leaves, ["doc_id", "changed"], "subtree")

    # One row a source. Its name is what follows the colon.
    named = F.when(F.col("tree") != "-", F.expr("substring(tree, instr(tree, ':') + 1)")).alias("name")
    sources = tops.filter("block = 0").select(F.lit("").alias("whole"), F.col("tree").alias("source"), named, F.col("top").alias("node"))
    sources = _placed(sources, "whole", [F.col("name").asc_nulls_first()], "sources")
    sources = sources.select(F.col("whole").alias("tree"), "at", "total", "node", "source")
    sources = expanded(*climbed(sources, ["source"], "root"), ["source"])
    sources = sources.select(F.col("source").alias("tree"), F.col("path").alias("rest"), F.col("top").alias("root"))

    # The way through the sources joins blocks, not rows.
    tops = tops.join(sources, "tree").select(
        "tree", "block", F.concat("above", "rest").alias("above"), F.col("top").alias("subroot"), "root"
    )
    rows = expanded(blocks, tops, ["doc_id", "changed"])
    return rows.select("doc_id", F.col("node").alias("leaf"), "changed", "subroot", "root", "path")


def proved(docs: DataFrame) -> DataFrame:
    """Leaves, roots and proofs of all documents, in the columns of the contract."""
    found = manifest(docs)
    again = folded(F.coalesce("changed", "leaf"), "path")
    found = found.select("doc_id", "leaf", "subroot", "root", proof_of("path").alias("proof_sha256"), again.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
