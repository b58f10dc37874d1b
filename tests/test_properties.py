"""Properties: counts + missing = rows, group sizes sum
to rows, shares sum to 100, dedup idempotent, results independent of the
partitioning."""

import pytest
from pyspark.sql import functions as F

from tablelens.operators import clean, engagement, groups, profile

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def orders(spark):
    o = spark.read.parquet(f"{SF}/orders.parquet")
    return o.withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 4 == 0, None).otherwise(F.col("o_orderpriority")))


def test_counts_plus_missing_equal_rows(orders):
    n = orders.count()
    for r in profile.numeric_profile(orders, ["o_totalprice", "o_custkey"]).collect():
        assert r["count"] + r.missing == n
    for r in profile.categorical_profile(orders, ["o_orderstatus", "o_orderpriority"]).collect():
        assert r["count"] + r.missing == n


def test_group_sizes_sum_to_rows(orders):
    n = orders.count()
    assert groups.group_sizes(orders, ["o_orderpriority"]).agg(F.sum("size")).first()[0] == n
    assert groups.group_size_stats(orders, ["o_custkey"]).first().row_count == n


def test_share_sums_to_100(orders):
    total = engagement.category_share(orders, "o_orderpriority").agg(F.sum("pct")).first()[0]
    assert total == pytest.approx(100.0, abs=0.5)


def test_dedup_idempotent(orders):
    d = orders.select("o_orderstatus", "o_orderpriority")
    once = clean.dedup(d)
    assert clean.dedup(once).count() == once.count()


@pytest.mark.parametrize("parts", [1, 3, 13])
def test_independent_of_partitioning(orders, parts):
    base = engagement.page_engagement(orders, "o_custkey", ["o_totalprice"], k=10, exact_scale=2)
    again = engagement.page_engagement(orders.repartition(parts), "o_custkey", ["o_totalprice"], k=10, exact_scale=2)
    assert base.orderBy("rank").collect() == again.orderBy("rank").collect()
    s1 = engagement.category_share(orders, "o_orderpriority").orderBy("rank").collect()
    s2 = engagement.category_share(orders.repartition(parts), "o_orderpriority").orderBy("rank").collect()
    assert s1 == s2
