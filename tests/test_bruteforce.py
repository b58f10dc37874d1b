"""Operators against brute force in plain Python on random frames with NULL
keys, ties and a hot value (hypothesis-generated)."""

from collections import Counter, defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tablelens.operators import engagement, groups, profile

KEYS = st.one_of(st.none(), st.sampled_from(["a", "b", "c", "d"]))
VALS = st.one_of(st.none(), st.integers(-3, 3).map(float))
ROWS = st.lists(st.tuples(KEYS, VALS, VALS), min_size=1, max_size=30)
SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def order_key(k):
    return (k is not None, k or "")  # NULL first, then ascending


@SETTINGS
@given(ROWS)
def test_categorical_profile_bruteforce(spark, rows):
    d = spark.createDataFrame(rows, "k string, x double, y double")
    got = profile.categorical_profile(d, ["k"]).first()
    vals = [r[0] for r in rows]
    present = [v for v in vals if v is not None]
    counts = Counter(present)
    assert got["count"] == len(present) and got.missing == len(vals) - len(present)
    assert got.unique_count == len(counts)
    if counts:
        top_n = max(counts.values())
        assert got.top_count == top_n and got.top_value == min(v for v, n in counts.items() if n == top_n)
    else:
        assert got.top_value is None and got.top_count == 0


@SETTINGS
@given(ROWS)
def test_top_groups_bruteforce(spark, rows):
    d = spark.createDataFrame(rows, "k string, x double, y double")
    got = [(r["rank"], r.k, r.size) for r in groups.top_groups(d, "k", k=3).orderBy("rank").collect()]
    sizes = Counter(r[0] for r in rows)
    expect = sorted(sizes.items(), key=lambda kv: (-kv[1], order_key(kv[0])))[:3]
    assert got == [(i + 1, k, n) for i, (k, n) in enumerate(expect)]


@SETTINGS
@given(ROWS)
def test_page_engagement_bruteforce(spark, rows):
    d = spark.createDataFrame(rows, "k string, x double, y double")
    got = [(r.k, r.total_engagement) for r in engagement.page_engagement(d, "k", ["x", "y"], k=2).orderBy("rank").collect()]
    tot = defaultdict(float)
    for k, x, y in rows:
        tot[k] += (x or 0.0) + (y or 0.0)
    expect = sorted(tot.items(), key=lambda kv: (-kv[1], order_key(kv[0])))[:2]
    assert [g[0] for g in got] == [e[0] for e in expect]
    assert [g[1] for g in got] == pytest.approx([e[1] for e in expect])


@SETTINGS
@given(ROWS)
def test_grouped_stats_bruteforce(spark, rows):
    d = spark.createDataFrame(rows, "k string, x double, y double")
    got = {(r.k, r["count"], r.min, r.max) for r in groups.grouped_numeric_stats(d, ["k"], ["x"], k=10).collect()}
    per = defaultdict(list)
    for k, x, _ in rows:
        if x is not None:
            per[k].append(x)
    expect = {(k, len(v), min(v), max(v)) for k, v in per.items()}
    assert got == expect


@SETTINGS
@given(ROWS)
def test_category_share_bruteforce(spark, rows):
    d = spark.createDataFrame(rows, "k string, x double, y double")
    got = [(r["rank"], r.k, r["count"]) for r in engagement.category_share(d, "k").orderBy("rank").collect()]
    sizes = Counter(r[0] for r in rows)
    expect = sorted(sizes.items(), key=lambda kv: (-kv[1], order_key(kv[0])))
    assert got == [(i + 1, k, n) for i, (k, n) in enumerate(expect)]
