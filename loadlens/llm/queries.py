"""The registered queries of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loadlens.llm import (
    check_sql,
    decontamination,
    html_extraction,
    merkle,
    near_dedup,
    packing,
    pii,
    quality_classifier,
    quality_rules,
    secrets,
    sharding,
    simhash,
    spelling,
    toxicity,
)
from loadlens.llm.common import shipped, table

Query = Callable[[SparkSession, str], DataFrame]


def _of(name: str, build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(table(shipped(spark), sf_dir, name))


def _with(other: str, build: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(table(shipped(spark), sf_dir, "documents"), table(spark, sf_dir, other))


def queries() -> dict[str, Query]:
    return {
        "op1_shuffled_shards": _of("documents", sharding.placed),
        "op2_divergence_rules": _of("documents", quality_rules.judged),
        "op3_personal_data": _of("documents", pii.found),
        "op4_setsketch_near_duplicates": _of("documents", near_dedup.near_duplicates),
        "op5_power_of_two_packing": _of("documents", packing.packed),
        "op6_weak_toxicity": _with("labels", toxicity.scored),
        "op7_random_indexing_quality": _with("labels", quality_classifier.scored),
        "op8_latent_decontamination": _with("benchmark", decontamination.contaminated),
        "op9_tree_model_main_text": _of("pages", html_extraction.extracted),
        "op10_forest_secret_scan": _of("documents", secrets.found),
        "op11_spelling_variants": _of("documents", spelling.grouped),
        "op12_gray_order_simhash": _of("documents", simhash.fingerprints),
        "op13_merkle_manifest": _of("documents", merkle.proved),
    }


#: Components by comparing every two documents that share a shingle.
_NEAR_DUPLICATES = r"""
    with recursive
    split as (
        select doc_id, list_filter(regexp_split_to_array(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[\x20\x09-\x0D]+'), lambda x: x <> '') w
        from documents),
    sets as (
        select doc_id, case
            when w is null or len(w) = 0 then cast([] as varchar[])
            when len(w) < 5 then [array_to_string(w, ' ')]
            else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end s
        from split),
    flat as (select doc_id, len(s) n, unnest(s) g from sets),
    links as (
        select a.doc_id a, b.doc_id b from flat a join flat b on a.g = b.g and a.doc_id <> b.doc_id
        group by a.doc_id, b.doc_id, a.n, b.n
        having 100 * count(*) >= 75 * (a.n + b.n - count(*))),
    reach as (
        select doc_id, doc_id other from sets
        union
        select r.doc_id, l.b from reach r join links l on l.a = r.other),
    least as (select doc_id, min(other) component_id from reach group by doc_id)
    select s.doc_id, cast(len(s.s) as bigint) n_shingles, l.component_id, s.doc_id = l.component_id kept
    from sets s join least l using (doc_id)"""


def oracle_sql() -> dict[str, str]:
    """Check SQL for the queries that SQL expresses plainly; the tests hold the others against plain versions."""
    rules = quality_rules
    divergence = check_sql.divergence(
        rules.COMMON_WORDS, rules.KINDS, rules.MIN_WORDS, rules.MIN_JUDGED, rules.MIN_COMMON,
        rules.MAX_CHAR_DISTANCE, rules.MAX_WORD_DISTANCE, rules.MAX_COVER,
    )
    return {
        "op2_divergence_rules": divergence,
        "op4_setsketch_near_duplicates": _NEAR_DUPLICATES,
        "op11_spelling_variants": check_sql.SPELLING,
        "op13_merkle_manifest": check_sql.MERKLE,
    }
