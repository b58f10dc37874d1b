"""Most frequent values by bucket bounds (A19-A21): exact whatever the data, few values counted where one stands out."""

import random
from collections import Counter

import pytest

from tablelens.operators.heavy import _cells, _counted, candidate_buckets, heavy_values


def brute(rows, k):
    out = []
    for i, c in enumerate("abcd"):
        counts = Counter(r[i] for r in rows if r[i] is not None)
        best = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:k]
        out += [(c, i, n + 1, v, m) for n, (v, m) in enumerate(best)]
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "a string, b string, c string, d string")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    skewed = lambda: f"h{int(rng.paretovariate(1.1)) % 500}"
    return [(f"u{i}", skewed() if i % 3 else None, rng.choice("xyz"), None) for i in range(4000)]


@pytest.mark.parametrize("k", [1, 4, 600])
@pytest.mark.parametrize(("buckets", "first"), [(4096, 32), (7, 2), (64, 1), (1, 1)])
def test_equals_counting_every_value(spark, rows, k, buckets, first):
    got = heavy_values(frame(spark, rows), list("abcd"), k, buckets, first)
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows, k))


def test_no_value_reaches_the_summary(spark):
    """Every value once, and one value twice: nothing stands out in any bucket."""
    rows = [(f"u{i}", "same", None, f"v{i % 1999}") for i in range(2000)]
    got = heavy_values(frame(spark, rows), list("abcd"), 2, buckets=16, first=2)
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows, 2))


def test_where_a_value_stands_out_few_are_counted(spark):
    rows = [("hot" if i % 2 else f"u{i}", None, None, None) for i in range(6000)]
    cells = _cells(frame(spark, rows), ["a"], 4096)
    head, rest = candidate_buckets(cells, 1, 8)
    assert rest.count() == 0 and _counted(cells, head).count() < 60  # of 3,001 distinct values


def test_empty_table(spark):
    assert heavy_values(frame(spark, []), list("abcd"), 3).collect() == []
