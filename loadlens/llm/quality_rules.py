"""Quality rules by divergence from language references, in DataFrame functions only.

Each text has three histograms: kinds of characters, the common words of its language among each
other, and common words against all other words (``cover``). The references are the same histograms
summed over all documents of a language that pass the base rules. A text goes when the Jensen-Shannon
distance of one of its histograms from the reference is over a limit. The limit of ``cover`` is a
share of the distance that a text without any common word has, so such a text always goes. Two
guards keep chance out: ``cover`` is judged from ``MIN_JUDGED`` words on, the common words among each
other from ``MIN_COMMON`` of them on.

A text without a language is judged by the one whose common words fill most of it (of several, the
first listed). A text in a language that is not listed has no words to compare; its characters are
compared with those of all documents.

A null or empty text has no words, so the base rule drops it. Null and repeated ids do not matter:
each row is judged by itself. An empty table gives an empty result. A very long text is counted
whole, in one row. Input columns are kept; one with the name of a new column is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadlens.llm.common import stored

#: Frequent words of each language.
COMMON_WORDS = {
    "en": "the of and to in a is that it for was on are with as by this be at from or an not have they",
    "fr": "de la le et les des en un du une que est pour qui dans par sur pas au plus avec ce il être sont",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero",
}

SPACE = "[^\\x20\\x09-\\x0D]"
MIN_WORDS = 50
MAX_REPEATED = 50
#: Words, and common words, from which a histogram of them is steady enough to judge.
MIN_JUDGED = 60
MIN_COMMON = 100
MAX_CHAR_DISTANCE = 0.30
MAX_WORD_DISTANCE = 0.50
#: Share of the distance of a text without common words.
MAX_COVER = 0.70
FIGURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
    "char_distance", "word_distance", "cover_distance", "kept",
)

#: Kinds of characters counted by removing them; white space and symbols come from the base figures, and what is left is the last kind.
KINDS = ("\\p{Lu}", "\\p{Nd}", "[.,;:!?'\"()-]")


def _base(rows: DataFrame) -> DataFrame:
    """``_row``, ``_tag`` and ``_text`` with base figures; all arrays belong to one text."""
    found = rows.withColumn("_words", F.array_remove(F.split("_text", "[\\x20\\x09-\\x0D]+"), ""))
    windows = F.when(
        F.size("_words") >= 3,
        F.transform(
            F.sequence(F.lit(0), F.size("_words") - 3),
            lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    found = found.withColumn("_n", F.size("_words")).withColumn("_windows", windows)
    # Only texts that repeat a window need the places of the repeated ones.
    placed = F.when(
        F.size(F.array_distinct("_windows")) < F.size("_windows"),
        F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    found = found.withColumn("_placed", placed)
    twice = F.filter(
        "_placed",
        lambda x, k: (F.get("_placed", k - 1)["h"] == x["h"]) | (F.get("_placed", k + 1)["h"] == x["h"]),
    )
    found = found.withColumn("_twice", F.sort_array(F.transform(twice, lambda x: x["i"])))
    # A word is counted with the last repeated window it lies in: windows are three words long.
    repeated = F.aggregate(
        F.transform(
            "_twice", lambda x, k: F.least(F.lit(3), F.coalesce(F.get("_twice", k + 1) - x, F.lit(3))).cast("long")
        ),
        F.lit(0).cast("long"),
        lambda total, x: total + x,
    )
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(SPACE))
    found = found.withColumn("_lines", lines)
    return found.select(
        "_row",
        "_tag",
        "_text",
        F.col("_n").cast("long").alias("n_words"),
        F.length(F.regexp_replace("_text", "[\\x20\\x09-\\x0D]+", "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated.alias("n_repeat_words"),
    )


def _listed(words: str) -> Column:
    return F.array(*[F.lit(w) for w in words.split()])


def _only(words: str, listed: str) -> Column:
    """Those of the words that are in the list."""
    known = listed.split()
    return F.filter(words, lambda w: w.isin(known))


def _by_language(language: str, each) -> Column:
    """``each(words)`` for the list of the row's language."""
    first, *rest = COMMON_WORDS.items()
    out = F.when(F.col(language) == first[0], each(first[1]))
    for name, listed in rest:
        out = out.when(F.col(language) == name, each(listed))
    return out


def _char_histogram() -> Column:
    """Counts of each kind of characters, the rest last."""
    size = F.length("_text")
    counts = [size - F.length(F.regexp_replace("_text", kind, "")) for kind in KINDS]
    counts += [size - F.col("word_chars"), F.col("n_symbols")]
    rest = size
    for count in counts:
        rest = rest - count
    return F.array(*[c.cast("long") for c in (*counts, rest)])


def _histograms(base: DataFrame) -> DataFrame:
    """Adds ``_lang``, ``_chars``, ``_hist`` (counts of the common words) and ``_cover`` (common, other words)."""
    found = base.withColumn("_chars", _char_histogram())
    found = found.withColumn("_letters", F.array_remove(F.split(F.lower("_text"), "[^\\p{L}]+"), ""))
    # Without a language: the one whose common words take up most of the text, the first listed of several.
    hits = [
        F.struct(F.size(_only("_letters", listed)).alias("hits"), F.lit(-k).alias("k"), F.lit(name).alias("name"))
        for k, (name, listed) in enumerate(COMMON_WORDS.items())
    ]
    tagged = F.when(F.col("_tag").isin(list(COMMON_WORDS)), F.col("_tag"))
    found = found.withColumn("_lang", F.when(F.col("_tag").isNull(), F.greatest(*hits)["name"]).otherwise(tagged))
    found = found.withColumn("_common", _by_language("_lang", lambda k: _only("_letters", k)))
    counts = _by_language(
        "_lang",
        lambda k: F.transform(
            _listed(k), lambda v: (F.size("_common") - F.size(F.array_remove("_common", v))).cast("long")
        ),
    )
    cover = F.array(F.size("_common").cast("long"), (F.size("_letters") - F.size("_common")).cast("long"))
    return found.select(
        *[c for c in base.columns if c not in ("_text", "_tag")], "_lang", "_chars", counts.alias("_hist"),
        F.when(F.col("_lang").isNotNull(), cover).alias("_cover"),
    )


def _distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance (base 2, from 0 to 1) of two histograms; null where one is empty."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    shares = F.zip_with(
        F.transform(counts, lambda x: x / total(counts)),
        F.transform(reference, lambda x: x / total(reference)),
        lambda p, q: F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(0.0)
        + F.when(q > 0, q * F.log2(2 * q / (p + q))).otherwise(0.0),
    )
    divergence = F.aggregate(shares, F.lit(0.0), lambda s, x: s + x) / 2
    return F.when((total(counts) > 0) & (total(reference) > 0), F.sqrt(F.greatest(divergence, F.lit(0.0))))


def measured(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with base figures, distances from the references and ``kept``."""
    names = list(COMMON_WORDS)
    own = [c for c in (docs.columns if keep is None else keep) if c not in FIGURES]
    rows = docs.select(
        F.struct(*own).alias("_row"), F.coalesce(F.col("text"), F.lit("")).alias("_text"), F.col("lang").alias("_tag")
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    found = stored(_histograms(_base(rows).withColumn("base_failed", failed)), "histograms")

    # Sums are combined before the exchange: a row a language and task.
    bins = {"_chars": len(KINDS) + 3, "_hist": max(len(w.split()) for w in COMMON_WORDS.values()), "_cover": 2}
    sums = [F.sum(F.get(c, F.lit(i))).alias(f"{c}{i}") for c, n in bins.items() for i in range(n)]
    totals = found.filter(~F.col("base_failed")).groupBy("_lang").agg(*sums).collect()  # one row a language
    totals = {r["_lang"]: r for r in totals}

    def reference(counts: str, name: str | None, n: int) -> Column:
        chosen = totals.values() if name is None else [totals[name]] if name in totals else []
        return F.array(*[F.lit(sum(int(r[f"{counts}{i}"] or 0) for r in chosen)).cast("long") for i in range(n)])

    def against(counts: str, own_counts: Column, whole: bool = False) -> Column:
        """The distance from the reference of the row's language, or (``whole``) of all documents without one."""
        out = F.lit(None).cast("double")
        if whole:
            out = F.when(F.col("_lang").isNull(), _distance(own_counts, reference(counts, None, bins[counts])))
        for name in names:
            n = len(COMMON_WORDS[name].split()) if counts == "_hist" else bins[counts]
            near = _distance(own_counts, reference(counts, name, n))
            out = F.coalesce(F.when(F.col("_lang") == name, near), out)
        return out

    chars, words, cover = F.col("_chars"), F.col("_hist"), F.col("_cover")
    bare = F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))
    found = found.withColumns(
        {
            "char_distance": against("_chars", chars, whole=True),
            "word_distance": against("_hist", words),
            "cover_distance": against("_cover", cover),
            "_bare": against("_cover", bare),
        }
    )
    common = F.get("_cover", F.lit(0))
    far = (
        (F.col("char_distance") > MAX_CHAR_DISTANCE)
        | ((common >= MIN_COMMON) & (F.col("word_distance") > MAX_WORD_DISTANCE))
        | ((common + F.get("_cover", F.lit(1)) >= MIN_JUDGED) & (F.col("cover_distance") > MAX_COVER * F.col("_bare")))
    )
    kept = (~F.col("base_failed") & ~F.coalesce(far, F.lit(False))).alias("kept")
    return found.select("_row.*", *FIGURES[:-1], kept)


def judged(docs: DataFrame) -> DataFrame:
    """Figures and verdict of all documents, in the columns of the contract."""
    found = measured(docs, ["doc_id"])
    return found.select("doc_id", *FIGURES[:6], "kept")
