"""Prefixes of files (S7, W8, W9, V20): the right rows, from the first files alone."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from tablelens.operators import roles
from tablelens.sources import first_file_rows, first_records, prefix_role_table, read_table


@pytest.fixture
def parquet(spark, tmp_path):
    """Twenty files of 50 rows, in order."""
    path = str(tmp_path / "the rows")
    spark.range(1000).withColumn("v", F.col("id") * 2).repartitionByRange(20, "id").sortWithinPartitions("id").write.parquet(path)
    return path


@pytest.mark.parametrize(("n", "files"), [(1, 1), (50, 2), (120, 4), (1000, 20), (5000, 20), (0, 1)])
def test_parquet_prefix_scans_the_first_files_only(spark, parquet, n, files):
    d = first_file_rows(spark, parquet, n)
    assert [r.id for r in d.collect()] == list(range(min(n, 1000)))
    every = sorted(spark.read.parquet(parquet).inputFiles())
    assert len(d.inputFiles()) <= max(files, 2) and sorted(d.inputFiles()) == every[: len(d.inputFiles())]


def write_files(folder, files):
    for name, rows in files.items():
        with open(folder / name, "w", encoding="utf-8", newline="") as f:
            csv.writer(f, lineterminator="\n").writerows([["k", " v "], *rows])


def test_delimited_prefix_equals_the_first_rows_of_all(spark, tmp_path):
    rng = random.Random(4)
    cell = lambda: "".join(rng.choices(["a", ",", '"', "\n", "\n\n", " b"], k=3))
    files = {f"{k}.csv": [[f"{k}-{i}", cell()] for i in range(n)] for k, n in enumerate([3, 0, 40, 1, 200])}
    write_files(tmp_path, files)
    rows = [tuple(r) for own in files.values() for r in own]
    for n in (0, 1, 3, 4, 43, 44, 60, 500):
        d = first_records(spark, str(tmp_path), n, ",", "place")
        assert d.columns == ["k", "v", "place"]
        assert [(r.k, r.v) for r in d.orderBy("place").collect()] == rows[:n]


def test_delimited_prefix_opens_no_later_file(spark, tmp_path):
    write_files(tmp_path, {"a.csv": [[i, i] for i in range(300)], "b.csv": [["x", "y"]]})
    (tmp_path / "c.csv").write_bytes(b"k,v\n" + b'"' * 999)  # would end the last record of a whole read
    opened = []
    plain = type(spark.read).text

    def text(self, path, *rest, **more):
        opened.append(path)
        return plain(self, path, *rest, **more)

    type(spark.read).text = text
    try:
        assert first_records(spark, str(tmp_path), 200, ",").count() == 200
    finally:
        type(spark.read).text = plain
    assert [p.rsplit("/", 1)[-1] for p in opened[1:]] == ["a.csv"]  # the first call lists files


def test_roles_of_a_prefix_equal_those_of_the_sorted_table(spark, tmp_path):
    rows = [[str(i) if i < 900 else "x", "" if i < 700 else "7", "", str(i % 9) if i % 10 else "t"] for i in range(1000)]
    write = lambda name, some: (tmp_path / name).write_text("a,b,c,d\n" + "".join(",".join(r) + "\n" for r in some))
    for k in range(10):
        write(f"{k}.csv", rows[100 * k : 100 * k + 100])
    path = str(tmp_path)
    whole = read_table(spark, path, row_seq="place")
    wanted = []
    for sample in ({"sample_values": 50}, {"sample_rows": 150}, {"sample_values": 950}):
        first = lambda n: wanted.append(n) or first_records(spark, path, n, ",", "place")
        got = prefix_role_table(first, lambda: whole, "place", prefixes=(60, 200), **sample)
        want = roles.role_table(whole, cols=["a", "b", "c", "d"], order_by="place", **sample)
        order = ["column_name", "position", "non_null", "numeric_count", "ratio", "role"]
        assert sorted(map(tuple, got.select(order).collect())) == sorted(map(tuple, want.select(order).collect()))
    assert wanted == [60, 200, 150, 60, 200]


def test_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    assert first_records(spark, str(tmp_path), 5, ",").columns == []
    (tmp_path / "b.csv").write_text("x,y\n")
    assert first_records(spark, str(tmp_path), 5, ",").collect() == []
