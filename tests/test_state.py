"""State of growing folders (A7-A18, G1): several runs equal one, old files stay unread, half runs count for nothing."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tablelens.operators import profile
from tablelens.operators.state import DISTINCT_ERROR, LG_K, RANK_ERROR, ProfileState, rank_of


@pytest.fixture
def rows(spark):
    rng = random.Random(3)
    made = [(round(rng.gauss(100, 30), 2) if rng.random() < 0.9 else None, None, rng.choice(["a", "b", None]), f"u{rng.randrange(4000)}") for _ in range(6000)]
    return spark.createDataFrame(made, "v double, none double, k string, u string")


def state(spark, root, **more):
    return ProfileState(spark, str(root / "state"), ["v", "none"], ["k", "u"], [["k"]], **more)


EXACT = ["column_name", "count", "missing", "mean", "std", "min", "max"]


def test_runs_of_any_number_equal_one(spark, rows, tmp_path):
    source = str(tmp_path / "a b")  # a name that is written otherwise in paths
    parts = rows.randomSplit([0.2, 0.3, 0.5], 4)
    grown = state(spark, tmp_path)
    for part in parts:
        part.write.mode("append").parquet(source)
        assert grown.update(source)
    assert grown.update(source) == []
    every = spark.read.parquet(source)
    assert len(grown.files()) == len(every.inputFiles())
    once = state(spark, tmp_path / "other")
    once.update(source)
    frames = [s.profile().where("position < 2").select(EXACT).orderBy("column_name").collect() for s in (grown, once)]
    assert frames[0] == frames[1]
    want = profile.numeric_profile(every, ["v", "none"], exact_scale=2)
    assert frames[0] == want.select(EXACT).orderBy("column_name").collect()
    sizes = {r.k: r["size"] for r in grown.group_sizes().collect()}
    assert sizes == {r.k: r["count"] for r in every.groupBy("k").count().collect()}
    found = {r.column_name: r for r in grown.profile().collect()}
    assert (found["k"]["count"], found["k"].missing, found["k"].distinct_count) == (every.where("k IS NOT NULL").count(), every.where("k IS NULL").count(), 2)
    exact = every.agg(F.count_distinct("u")).first()[0]
    assert abs(found["u"].distinct_count - exact) <= exact * DISTINCT_ERROR
    assert found["none"].q50 is None and found["none"]["count"] == 0
    for p in (25, 50, 75):
        low, high = every.agg(*[c.alias(str(i)) for i, c in enumerate(rank_of(F.col("v"), F.lit(found["v"][f"q{p}"])))]).first()
        assert low - RANK_ERROR <= p / 100 <= high + RANK_ERROR


def test_old_files_are_not_read_again(spark, rows, tmp_path):
    source = tmp_path / "rows"
    rows.write.parquet(str(source))
    grown = state(spark, tmp_path)
    assert grown.update(str(source))
    for name in os.listdir(source):
        if name.endswith(".parquet"):
            (source / f".{name}.crc").unlink(missing_ok=True)
            (source / name).write_bytes(b"no longer Parquet")
    rows.limit(10).coalesce(1).write.mode("append").parquet(str(source))
    assert len(grown.update(str(source), lambda paths: spark.read.schema(rows.schema).parquet(*paths))) == 1
    assert sum(r["size"] for r in grown.group_sizes().collect()) == 6010


def test_half_an_update_counts_for_nothing(spark, rows, tmp_path, monkeypatch):
    source = str(tmp_path / "rows")
    rows.write.parquet(source)
    broken = ProfileState(spark, str(tmp_path / "state"), ["v", "none"], ["k", "u"], [["no such column"]])
    with pytest.raises(Exception, match="no such column"):
        broken.update(source)  # its columns are written by then
    good = state(spark, tmp_path)
    assert good.files() == set() and good.profile().collect() == []
    assert good.update(source) and good.profile().where("column_name = 'v'").first()["count"] > 0
    with pytest.raises(ValueError, match="no update yet"):
        state(spark, tmp_path / "none").group_sizes()


def test_values_that_do_not_fit_and_columns_of_text(spark, tmp_path):
    source = str(tmp_path / "rows")
    spark.createDataFrame([("1.5", "x"), ("abc", None), ("0.333333", "y")], "v string, none string").withColumn("k", F.lit("a")).withColumn("u", F.lit(1)).write.parquet(source)
    grown = state(spark, tmp_path)
    grown.update(source)
    v = grown.profile().where("column_name = 'v'").first()
    assert (v["count"], v.missing, v["std"]) == (2, 1, None) and v["mean"] == pytest.approx(0.9166665)
    assert LG_K == 14
