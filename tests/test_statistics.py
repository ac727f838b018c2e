"""Profiles merged from parts, statistics of declared indexes, and an index against its table."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from frames import DAY, row_set, rows
from loadlens import operators as op
from loadlens.sources import read_report, write_report

SCHEMA = (
    "day date, n bigint, small int, d double, dec decimal(20,4), txt string, ok boolean, at timestamp, "
    "took interval day to second, arr array<int>, bin binary"
)


def events(spark, days=4, each=3000):
    draw = random.Random(3)
    data = []
    for k in range(days):
        for i in range(each):
            n = draw.randint(-50, 2000 * (k + 1))
            data.append(
                (date(2024, 1, 1 + k), None if i % 7 == 0 else n, n % 9, n / 8 if n % 5 else -0.0, Decimal(n) / 16,
                 f"t{n}", n % 2 == 0, DAY + timedelta(seconds=n), timedelta(seconds=n), [n, 1], str(n).encode())
            )
    return spark.createDataFrame(data, SCHEMA)


def test_merged_parts_are_the_profile_of_all(spark, tmp_path):
    df, root = events(spark), str(tmp_path)
    days = [date(2024, 1, 1 + k) for k in range(4)]
    for day in [*days, days[1]]:  # one day twice: a rerun replaces it
        part = op.profile_parts({"E": df.where(F.col("day") == F.lit(day))}, owner="O", part={"E": "day"})
        write_report(part, root, "profile", day=day)
    stored = read_report(spark, root, "profile", part.schema)
    merged = op.merged_profile(stored, as_of=DAY)
    whole = op.table_profile({"E": df}, as_of=DAY, owner="O", exact_distinct=True)
    assert merged.columns == whole.columns
    assert row_set(merged.drop("num_distinct")) == row_set(whole.drop("num_distinct"))
    exact = {r["column_name"]: r["num_distinct"] for r in whole.collect()}
    for r in merged.collect():
        assert abs(r["num_distinct"] - exact[r["column_name"]]) <= 0.05 * exact[r["column_name"]], r
    (scan,) = [x for x in stored.where(F.col("report_day") == days[0])._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x]
    assert "report_day" in scan.split("PartitionFilters")[1]


def test_parts_without_rows_values_or_owner(spark):
    df = spark.createDataFrame([(None, None), (None, 3)], "p string, n bigint")
    parts = op.profile_parts({"T": df, "U": df.limit(0)}, part={"T": "p"})
    got = row_set(op.merged_profile(parts, as_of=DAY), "owner", "table_name", "column_name", "num_rows", "num_nulls", "num_distinct", "min_value")
    assert [r for r in got if r[1] == "T"] == [(None, "T", "n", 2, 1, 1, "3"), (None, "T", "p", 2, 2, 0, None)]


def test_widths_are_those_of_storage(spark):
    df = spark.createDataFrame(
        [(Decimal("1.50"), Decimal(1), Decimal(1), timedelta(minutes=3), [1, 2, 3], "é")],
        "a decimal(9,2), b decimal(18,0), c decimal(30,0), d interval day to second, e array<bigint>, f string",
    )
    got = op.table_profile({"T": df}, as_of=DAY, owner="O")
    assert rows(got, "owner", "avg_col_len") == [("O", n) for n in (4, 8, 16, 8, 24, 2)]


def test_index_statistics_as_plain_counts(spark):
    data = [(1, "a", 0.0), (1, "a", -0.0), (1, None, 1.0), (None, None, None), (None, "a", 2.0), (2, "x" * 99, 2.0), (2, "x" * 99, 2.0)]
    t = {"T": spark.createDataFrame(data, "k bigint, s string, d double").repartition(3), "U": spark.createDataFrame([], "k int")}
    made = [op.Index("O", "K", "T", ("k",)), op.Index("O", "KS", "T", ("k", "s"), unique=True), op.Index("O", "D", "T", ("d",)),
            op.Index("O", "E", "U", ("k",))]
    got = op.index_profile(t, made, table_owner="TO")
    assert row_set(got, "index_name", "uniqueness", "num_rows", "distinct_keys") == [
        ("D", "NONUNIQUE", 6, 3), ("E", "NONUNIQUE", 0, 0), ("K", "NONUNIQUE", 5, 2), ("KS", "UNIQUE", 6, 4)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate inline(array(") == 2  # one read a table


def test_gathered_statistics_feed_the_size_estimate(spark):
    t = {"T": spark.createDataFrame([(i, f"v{i % 10}") for i in range(1000)], "k bigint, s string")}
    made = [op.Index("O", "KS", "T", ("k", "s")), op.Index("O", "NONE", "T", ("s",))]
    catalog = op.profiled_catalog(spark, t, made, owner="TO", as_of=DAY)
    catalog["index_segment"] = spark.createDataFrame([("O", "KS", 65536)], "owner string, segment_name string, bytes bigint")
    (row,) = op.index_size_estimate(catalog).collect()
    assert (row["num_rows"], row["distinct_keys"], row["avg_row_len"]) == (1000, 1000, 10)
    assert row["pct_used"] == round((1000 * 12 + 1000 * 10 * 1.1) / 65536 * 100, 2)


def plain_verdicts(table, index):
    t, i = Counter(table), Counter(index)
    by = defaultdict(list)
    for entry in t.keys() | i.keys():
        if t[entry] != i[entry]:
            by[entry[0]].append((t[entry], i[entry]))
    out = []
    for k, counts in by.items():
        missing, foreign = any(a > b for a, b in counts), any(a == 0 for a, b in counts)
        verdict = ("changed" if foreign else "lost") if missing else "stray" if foreign else "doubled"
        out.append((k, verdict, sum(max(a - b, 0) for a, b in counts), sum(max(b - a, 0) for a, b in counts)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("buckets", [1, 7, 4096])
def test_every_unmatched_entry_is_named(spark, buckets):
    table = [(k, k % 50, None if k % 4 == 0 else f"v{k % 3}") for k in range(800)] + [(None, 1, "n"), (5, 5, "twice"), (5, 5, "twice")]
    index = [e for e in table if e[0] != 17] + [(18, 18, "v0"), (19, 99, "v1"), (-1, 1, "x"), (5, 5, "twice")]
    index.remove((20, 20, None))
    index.append((20, 21, None))
    schema = "k bigint, a bigint, b string"
    sides = [spark.createDataFrame(x, schema).repartition(3) for x in (table, index)]
    got = op.index_discrepancies(*sides, keys=("a", "b"), locator=("k",), buckets=buckets)
    assert row_set(got) == plain_verdicts(table, index)
    verdicts = dict(rows(got, "k", "verdict"))
    assert verdicts == {17: "lost", 18: "doubled", 19: "stray", 20: "changed", -1: "stray", 5: "doubled"}
    assert op.index_discrepancies(sides[0], sides[0], keys=("a",), locator=("k",)).count() == 0


def test_an_index_is_validated_against_its_table(spark, tmp_path):
    table, good, bad = (str(tmp_path / n) for n in ("t", "good", "bad"))
    df = spark.range(100).selectExpr("id", "id % 7 as k")
    df.write.parquet(table)
    df.write.parquet(good)
    df.where("id <> 3").selectExpr("id", "case when id = 4 then 99 else k end as k").union(df.where("id = 5")).write.parquet(bad)
    of = op.Dataset("O", "T", table, keys=("id",))
    made = [of, *[op.Dataset("O", n, p, "INDEX", keys=("k",), of=of, locator=("id",)) for n, p in (("GOOD", good), ("BAD", bad))]]
    got = {r["object_name"]: r for r in op.validate_tables(spark, made, owner="O").collect()}
    assert [got[n]["status"] for n in ("T", "GOOD", "BAD")] == ["OK", "OK", "FAILED"]
    assert got["BAD"]["message"] == "INDEX O.BAD does not match O.T: 1 lost, 1 doubled, 1 changed"


def test_a_side_with_values_of_unknown_length_is_never_small(spark):
    from loadlens.operators.common import is_small

    assert is_small(spark.sql("select 1 a, 'x' b, cast('x' as binary) c"))
    for kind in ("array(1)", "map(1, 2)", "struct(1)"):
        assert not is_small(spark.sql(f"select {kind} a"))
