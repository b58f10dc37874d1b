"""Profiles: overview (A1-A6), null counts (A4, A8), numeric profile (A7-A15,
V11, V12, V23), categorical profile (A17-A22, V13, V14, V19), value counts."""

import statistics

import random
from decimal import Decimal, localcontext
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tablelens.operators import profile
from tablelens.operators.roles import ColumnRoles


def test_overview_and_nulls(spark):
    d = spark.createDataFrame([(1, None, "a"), (2, 3.0, None), (None, None, "b")], "i long, x double, s string")
    ov = profile.dataset_overview(d, ColumnRoles(("i", "x"), ("s",))).first()
    assert (ov.row_count, ov.column_count, ov.numeric_columns, ov.text_columns) == (3, 3, 2, 1)
    assert ov.missing_cells == 4 and ov.missing_pct == 44.4 and ov.columns_with_nulls == 3
    nc = {r.column_name: (r.row_count, r.non_null, r.missing) for r in profile.null_counts(d).collect()}
    assert nc == {"i": (3, 2, 1), "x": (3, 1, 2), "s": (3, 2, 1)}


def test_overview_of_empty_table(spark):
    d = spark.createDataFrame([], "i long, s string")
    ov = profile.dataset_overview(d).first()
    assert ov.row_count == 0 and ov.missing_cells == 0 and ov.missing_pct is None


def test_numeric_profile_sample_and_population(spark):
    vals = [1.0, 2.0, 4.0, 8.0, None]
    d = spark.createDataFrame([(v, "1" if v else None) for v in vals], "x double, one string")
    s = {r.column_name: r for r in profile.numeric_profile(d, ["x", "one"]).collect()}
    x = s["x"]
    assert (x["count"], x.missing, x.min, x.max) == (4, 1, 1.0, 8.0)
    assert x.mean == pytest.approx(3.75)
    assert x.std == pytest.approx(statistics.stdev([1, 2, 4, 8]))
    # A single distinct value: sample deviation 0 here (four equal values).
    assert s["one"].std == 0.0
    p = {r.column_name: r for r in profile.numeric_profile(d, ["x"], ddof=0).collect()}
    assert p["x"].std == pytest.approx(statistics.pstdev([1, 2, 4, 8]))


def test_numeric_profile_edge_rows(spark):
    d = spark.createDataFrame([(5.0, None), (None, None)], "single double, empty double")
    s = {r.column_name: r for r in profile.numeric_profile(d, ["single", "empty"]).collect()}
    assert s["single"]["count"] == 1 and s["single"].std is None  # sample deviation of one value (V12)
    assert s["empty"]["count"] == 0 and s["empty"].missing == 2 and s["empty"].mean is None  # V23
    p = {r.column_name: r for r in profile.numeric_profile(d, ["single"], ddof=0).collect()}
    assert p["single"].std == 0.0


def test_quartiles(spark):
    import numpy as np

    vals = [float(v) for v in [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5]]
    d = spark.createDataFrame([(v,) for v in vals], "x double")
    r = profile.numeric_profile(d, ["x"], quantile_probs=(0.25, 0.5, 0.75)).first()
    assert (r.q25, r.q50, r.q75) == pytest.approx(tuple(np.quantile(vals, [0.25, 0.5, 0.75])))


def test_exact_scale_adds_what_does_not_fit(spark):
    """Small, huge and infinite values are neither rounded, refused nor lost."""
    inf = float("inf")
    cases = {"small": [0.004, 0.004], "huge": [1e17, 0.25], "endless": [1.0, inf, inf], "plain": [0.1, 0.2], "none": [None, None]}
    for name, values in cases.items():
        d = spark.createDataFrame([(v,) for v in values], "x double")
        exact = profile.numeric_profile(d, ["x"], exact_scale=2).first().mean
        plain = profile.numeric_profile(d, ["x"]).first().mean
        assert exact == plain if name != "plain" else exact == 0.15, name


def test_exact_median_midpoint(spark):
    d = spark.createDataFrame([(1.0,), (2.0,), (10.0,), (20.0,)], "x double")
    r = profile.numeric_profile(d, ["x"], quantile_probs=(0.5,)).first()
    assert r.q50 == 6.0  # mean of the two middle values (A13)


def test_categorical_profile(spark):
    rows = [("b", None, 1), ("a", None, 2), ("b", None, 3), ("a", None, 4), ("c", None, 5), (None, None, 6)]
    d = spark.createDataFrame(rows, "s string, allnull string, n int")
    p = {r.column_name: r for r in profile.categorical_profile(d, ["s", "allnull"]).collect()}
    s = p["s"]
    # Tie between a and b (2 each): the smaller value wins (V19); NULL never tops.
    assert (s["count"], s.missing, s.unique_count, s.top_value, s.top_count) == (5, 1, 3, "a", 2)
    a = p["allnull"]
    assert (a["count"], a.missing, a.unique_count, a.top_value, a.top_count) == (0, 6, 0, None, 0)  # A22
    with_null = {r.column_name: r.unique_count for r in profile.categorical_profile(d, ["s"], count_null_as_value=True).collect()}
    assert with_null["s"] == 4  # A18
    limited = profile.categorical_profile(d, ["s", "allnull", "n"], max_cols=2)
    assert limited.count() == 2


def test_distinct_counts(spark):
    d = spark.createDataFrame([("a",), ("b",), (None,), ("a",)], "s string")
    assert profile.distinct_counts(d, ["s"]).first().distinct_count == 2
    assert profile.distinct_counts(d, ["s"], count_null=True).first().distinct_count == 3
    assert profile.distinct_counts(d, ["s"], approx=True).first().distinct_count == 2


def test_value_counts(spark):
    d = spark.createDataFrame([(v,) for v in "aabbbc"] + [(None,)], "s string")
    vc = [(r["rank"], r.value, r["count"], r.pct) for r in profile.value_counts(d, "s").orderBy("rank").collect()]
    assert vc == [(1, "b", 3, 42.9), (2, "a", 2, 28.6), (3, "c", 1, 14.3)]
    with_null = profile.value_counts(d, "s", dropna=False).count()
    assert with_null == 4


def test_long_texts_by_digest(spark):
    """The digest form gives the plain form's rows, also for ties between long texts with one beginning."""
    head = "h" * 64
    cases = {
        "long tie": [head + "b", head + "a", head + "c", head + "b", head + "a", "zz"],
        "short first": [head, head + "a", None],
        "short wins": ["x", "x", head + "a", head + "b"],
        "unique": [f"{head}{i}" for i in range(30)],
        "null": [None, None],
    }
    for name, values in cases.items():
        d = spark.createDataFrame([(v, "k") for v in values], "t string, u string")
        both = [
            sorted(profile.categorical_profile(d, ["u", "t"], count_null_as_value=True, long_text=some).collect())
            for some in ([], ["t"], ["t", "u"])
        ]
        assert both[0] == both[1] == both[2], name
    empty = spark.createDataFrame([], "t string")
    assert profile.categorical_profile(empty, ["t"], long_text=["t"]).first().unique_count == 0


def _exact_std(values, scale, ddof):
    """Of whole units, with fractions; rounded once."""
    units = [round(v * 10**scale) for v in values]
    mean = Fraction(sum(units), len(units))
    spread = sum((u - mean) ** 2 for u in units) / (len(units) - ddof)
    with localcontext() as c:
        c.prec = 60
        return float((Decimal(spread.numerator) / Decimal(spread.denominator)).sqrt() / 10**scale)


@pytest.mark.parametrize("ddof", [0, 1])
def test_exact_deviation_has_the_same_bits_in_any_order(spark, ddof):
    rng = random.Random(ddof)
    columns = {
        "money": [round(rng.uniform(-500, 90_000), 2) for _ in range(3000)],
        "far": [round(1e13 + rng.random(), 2) for _ in range(3000)],  # the built-in loses digits here
        "same": [12345.67] * 3000,
        "one": [5.25] + [None] * 2999,
    }
    d = spark.createDataFrame(list(zip(*columns.values(), strict=True)), ", ".join(f"{c} double" for c in columns))
    seen = set()
    for k in (1, 3, 8, 17, 40):
        rows = profile.numeric_profile(d.orderBy(F.rand(k)).repartition(k), list(columns), ddof=ddof, exact_scale=2).collect()
        seen.add(tuple((r.column_name, r["std"], r["mean"]) for r in rows))
    assert len(seen) == 1
    std = {c: s for c, s, _ in seen.pop()}
    for c in ("money", "far"):
        assert std[c] == pytest.approx(_exact_std(columns[c], 2, ddof), rel=1e-14)
    assert std["same"] == 0.0 and std["one"] == (0.0 if ddof == 0 else None)


def test_deviation_of_values_that_do_not_fit_is_the_built_in(spark):
    d = spark.createDataFrame([(1 / 3, 9e15, None), (2.5, -9e15, None), (7.0, 3.0, None)], "a double, b double, c double")
    exact = {r.column_name: r["std"] for r in profile.numeric_profile(d, ["a", "b", "c"], exact_scale=2).collect()}
    plain = {r.column_name: r["std"] for r in profile.numeric_profile(d, ["a", "b", "c"]).collect()}
    assert exact["a"] == pytest.approx(plain["a"]) and exact["b"] == pytest.approx(plain["b"], rel=1e-12) and exact["c"] is None
    huge = spark.range(300).select((F.lit(9.9e17) * F.when(F.col("id") % 2 == 0, 1).otherwise(-1)).alias("v"))  # squares need 39 digits
    a, b = (profile.numeric_profile(huge, ["v"], exact_scale=s).first()["std"] for s in (0, None))
    assert a == pytest.approx(b)


def test_whole_numbers_keep_64_bits(spark):
    big = 2**53
    d = spark.createDataFrame([(big + 1, 1), (big + 3, None), (-(2**63), 2), (2**63 - 1, 3)], "a bigint, b int")
    a, b = profile.whole_number_profile(d).collect()
    assert (a.min, a.max, int(a.total), a.missing) == (-(2**63), 2**63 - 1, 2 * big + 3, 0)
    assert (b.min, b.max, int(b.total), b["mean"], b.missing) == (1, 3, 6, 2.0, 1)
    with pytest.raises(ValueError, match="not whole numbers"):
        profile.whole_number_profile(d.withColumn("c", F.lit(1.5)), ["c"])
    empty = profile.whole_number_profile(d.limit(0)).first()
    assert (empty["count"], empty.min, empty.total, empty["mean"]) == (0, None, None, None)
    assert profile.whole_number_profile(d.select(F.lit("x").alias("t"))).collect() == []
