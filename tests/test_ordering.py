"""Distributed global rank and exact quantiles against brute force, with a
hot value holding a third of the rows (the skew case)."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablelens.operators.ordering import approx_quantiles, global_rank, quantiles


def skewed_values(n, seed):
    rnd = random.Random(seed)
    hot = 42.0
    return [hot if i % 3 == 0 else float(rnd.randint(0, 50)) for i in range(n)]


def test_global_rank_matches_sort(spark):
    rnd = random.Random(7)
    rows = [(i, rnd.randint(0, 20)) for i in range(500)]
    d = spark.createDataFrame(rows, "id int, n int").repartition(7)
    ranked = global_rank(d, [F.desc("n"), F.asc("id")]).collect()
    expect = sorted(rows, key=lambda r: (-r[1], r[0]))
    got = sorted(ranked, key=lambda r: r["rank"])
    assert [(r.id, r.n) for r in got] == expect
    assert [r["rank"] for r in got] == list(range(1, 501))


@pytest.mark.parametrize("seed", [1, 2])
def test_distributed_quantiles_grouped_skewed(spark, seed):
    vals = skewed_values(3000, seed)
    rows = [("g%d" % (i % 4) if i % 5 else None, v) for i, v in enumerate(vals)]
    d = spark.createDataFrame(rows, "g string, v double").repartition(6)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    out = {r.g: r for r in quantiles(d, ["g"], "v", probs).collect()}
    for g in {r[0] for r in rows}:
        expect = np.quantile([v for k, v in rows if k == g], probs)
        got = [out[g][c] for c in out[g].__fields__[1:]]
        assert got == pytest.approx(list(expect)), g


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=40))
def test_distributed_quantiles_property(spark, values):
    d = spark.createDataFrame([(float(v),) for v in values], "v double").withColumn("g", F.lit(1))
    r = quantiles(d, ["g"], "v", [0.25, 0.5, 0.75]).first()
    assert [r.q25, r.q50, r.q75] == pytest.approx(list(np.quantile(values, [0.25, 0.5, 0.75])))


def test_global_rank_with_columns_outside_the_order(spark):
    """Payload columns, kept or pruned by the caller, never change the ranks."""
    n = 200_000
    d = spark.range(0, n, 1, 7).select(
        (F.col("id") % 97).cast("string").alias("s"), "id", F.repeat(F.col("id").cast("string"), 5).alias("payload")
    )
    ranked = global_rank(d, [F.desc("s"), F.asc("id")])
    for some in (ranked.select("rank"), ranked, ranked.select("rank", "payload")):
        r = some.agg(F.count_distinct("rank"), F.min("rank"), F.max("rank")).first()
        assert tuple(r) == (n, 1, n)
    keys = sorted(((str(i % 97), i) for i in range(n)), key=lambda k: k[1])
    keys.sort(key=lambda k: k[0], reverse=True)
    top = {r["rank"]: r.id for r in ranked.where("rank % 20001 = 5").collect()}
    assert top == {k + 1: keys[k][1] for k in range(4, n, 20001)}


def test_ranks_and_counts_read_the_same_files(spark):
    ranked = global_rank(spark.range(1000), [F.desc("id")])
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2 and "RepartitionByExpression" not in plan


@pytest.mark.parametrize("accuracy", [10_000, 20])
def test_quantiles_with_narrow_brackets(spark, accuracy):
    """Groups above and below the size that is bracketed, hot values, ties, infinities."""
    rnd = random.Random(11)
    rows = [("big", float(rnd.choice([7, 7, 7, rnd.randint(-500, 500)]))) for _ in range(5000)]
    rows += [("even", float(i)) for i in range(999)] + [("tiny", 3.0), ("tiny", 1.0)] + [(None, rnd.random()) for _ in range(700)]
    rows += [("inf", float("inf"))] * 40 + [("inf", 1.0)] * 20 + [("gone", None)]
    d = spark.createDataFrame(rows, "g string, v double").repartition(5)
    probs = [0.0, 0.013, 0.25, 0.5, 0.9, 1.0]
    for few in (True, False):
        out = {r.g: list(r)[1:] for r in quantiles(d, ["g"], "v", probs, accuracy, few).collect()}
        assert set(out) == {"big", "even", "tiny", "inf", None}
        for g in out:
            values = [v for k, v in rows if k == g]
            assert out[g] == pytest.approx(list(np.quantile(values, probs, method="lower")) if g == "inf" else list(np.quantile(values, probs)))


def test_infinite_values(spark):
    d = spark.createDataFrame([(1.0,), (float("inf"),), (float("inf"),), (float("-inf"),), (0.0,)], "v double")
    r = quantiles(d.withColumn("g", F.lit(1)), ["g"], "v", [0.0, 0.125, 0.25, 0.5, 0.625, 0.75, 1.0]).first()
    assert list(r)[1:] == [float("-inf"), float("-inf"), 0.0, 1.0, float("inf"), float("inf"), float("inf")]


def test_approx_quantiles(spark):
    d = spark.createDataFrame([("a", float(v)) for v in range(101)], "g string, v double")
    assert approx_quantiles(d, ["g"], "v", [0.25, 0.5]).first() == ("a", 25.0, 50.0)


def test_empty_inputs(spark):
    from tablelens.operators import engagement, groups, profile

    empty = spark.createDataFrame([], "k string, v double")
    assert global_rank(empty, [F.asc("k")]).count() == 0
    assert engagement.category_share(empty, "k").count() == 0
    assert profile.value_counts(empty, "k").count() == 0
    assert quantiles(empty.withColumn("g", F.lit(1)), ["g"], "v", [0.5]).count() == 0
    q = profile.numeric_profile(empty, ["v"], quantile_probs=(0.5,)).first()
    assert q["count"] == 0 and q.q50 is None
    assert groups.top_groups(empty, "k").count() == 0
    s = groups.group_size_stats(empty, "k").first()
    assert s.group_count == 0 and s.q50 is None


def test_quantiles_with_null_only_group(spark):
    d = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None)], "g string, v double")
    out = {r.g: r.q50 for r in quantiles(d, ["g"], "v", [0.5]).collect()}
    assert out == {"a": 2.0}
