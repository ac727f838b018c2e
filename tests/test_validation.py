"""Validation of stored datasets, sound and damaged."""

from __future__ import annotations

from frames import rows
from loadlens.operators import Dataset, validate_tables
from loadlens.sources import GIVEN, given_path

COLUMNS = ["object_name", "num_rows", "null_keys", "duplicate_keys", "status"]


def write(spark, data, schema, path):
    spark.createDataFrame(data, schema).coalesce(1).write.parquet(path)
    return path


def test_one_damaged_dataset_does_not_stop_the_rest(spark, tmp_path):
    good = write(spark, [(1, "a"), (2, "b")], "k int, v string", str(tmp_path / "good"))
    keys = write(spark, [(1, "a"), (1, "b"), (None, "c")], "k int, v string", str(tmp_path / "keys"))
    broken = tmp_path / "broken"
    broken.mkdir()
    (broken / "part-0.parquet").write_bytes(b"PAR1 this is no parquet file PAR1")
    datasets = [
        Dataset("O", "BROKEN", str(broken)),
        Dataset("O", "MISSING", str(tmp_path / "missing")),
        Dataset("O", "GOOD", good, keys=("k",)),
        Dataset("O", "KEYS", keys, kind="INDEX", keys=("k",)),
        Dataset("O", "NOT_ASKED", good, kind="VIEW"),
        Dataset("X", "OTHER_OWNER", good),
    ]
    got = validate_tables(spark, datasets, owner="O")
    assert rows(got, *COLUMNS) == [
        ("BROKEN", None, None, None, "FAILED"),
        ("MISSING", None, None, None, "ERROR"),
        ("GOOD", 2, 0, 0, "OK"),
        ("KEYS", 3, 1, 1, "FAILED"),
    ]
    assert rows(got, "position")[2] == ("ELEMENT #3 of 4: O.GOOD (TABLE)",)
    messages = dict(rows(got, "object_name", "message"))
    assert messages["GOOD"] == "TABLE O.GOOD successfully validated"
    assert "successfully" not in messages["BROKEN"] + messages["KEYS"]


def test_maps_inside_other_types_are_read(spark, tmp_path):
    schema = "k int, a array<map<string,int>>, s struct<m:map<string,int>>, m map<string,int>"
    path = write(spark, [(1, [{"x": 1}], ({"y": 2},), {"z": 3})], schema, str(tmp_path / "maps"))
    got = validate_tables(spark, [Dataset("O", "MAPS", path, keys=("k",))], owner="O")
    assert rows(got, *COLUMNS) == [("MAPS", 1, 0, 0, "OK")]


def test_wrong_key_name_is_no_damage(spark, tmp_path):
    path = write(spark, [(1,)], "k int", str(tmp_path / "t"))
    got = validate_tables(spark, [Dataset("O", "T", path, keys=("no_such",))], owner="O")
    assert rows(got, *COLUMNS) == [("T", None, None, None, "ERROR")]


def test_damage_inside_a_column_is_found(spark, tmp_path):
    data = [(i, f"value {i * 7919 % 1000003}") for i in range(20_000)]
    path = tmp_path / "t"
    write(spark, data, "k int, v string", str(path))
    (part,) = path.glob("part-*.parquet")
    content = bytearray(part.read_bytes())
    middle = len(content) // 2
    content[middle : middle + 4000] = b"\xff" * 4000
    part.write_bytes(content)
    for checksum in path.glob(".part-*.crc"):
        checksum.unlink()
    assert rows(validate_tables(spark, [Dataset("O", "T", str(path))], owner="O"), "status") == [
        ("FAILED",)
    ]


def test_single_object_and_no_object(spark):
    sf_dir = "/root/testdata/sf0.001"
    given = [Dataset("GIVEN", n, given_path(sf_dir, n)) for n in GIVEN]
    got = validate_tables(spark, given, owner="GIVEN", name="orders", workers=1)
    assert rows(got, "position", "num_rows", "status") == [
        ("ELEMENT #1 of 1: GIVEN.orders (TABLE)", 1500, "OK")
    ]
    assert rows(validate_tables(spark, given, owner="NOBODY")) == []
