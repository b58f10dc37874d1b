"""Cleaning: null policies (S3), coercion (T5, V5-V7), dates (S8), JSON
and deduplication (U1-U4, V9)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tablelens.operators import clean


def test_normalise_nulls_policies(spark):
    d = spark.createDataFrame([(" NA ", 1), ("none", 2), ("", 3), ("ok ", 4)], "s string, n int")
    assert [r.s for r in clean.normalise_nulls(d, "strict").orderBy("n").collect()] == [None, "none", None, "ok"]
    assert [r.s for r in clean.normalise_nulls(d, "folded").orderBy("n").collect()] == [None, None, None, "ok"]
    assert [r.s for r in clean.normalise_nulls(d, "empty", trim=False).orderBy("n").collect()] == [" NA ", "none", None, "ok "]
    # Non-text columns are left alone.
    assert clean.normalise_nulls(d).schema == d.schema


def test_coerce_numeric_keeps_order_and_names(spark):
    d = spark.createDataFrame([("1", "x", "2.5"), ("bad", "y", "nan")], "`a b` string, t string, c string")
    out = clean.coerce_numeric(d, ["a b", "c"])
    assert out.columns == ["a b", "t", "c"]
    assert [tuple(r) for r in out.collect()] == [(1.0, "x", 2.5), (None, "y", None)]


def test_coerce_dates_only_when_all_parse(spark):
    d = spark.createDataFrame(
        [("2024-01-02", "2024-01-02 03:04:05", "2024-13-45"), ("2024-02-03", None, "2024-01-01")],
        "d1 string, d2 string, bad string",
    )
    out = clean.coerce_dates(d)
    types = dict(out.dtypes)
    assert types["d1"] == "timestamp_ntz" and types["d2"] == "timestamp_ntz" and types["bad"] == "string"
    first = out.orderBy("d1").first()
    assert first.d1 == dt.datetime(2024, 1, 2) and first.d2 == dt.datetime(2024, 1, 2, 3, 4, 5)
    rep = {r.column_name: (r.non_null, r.parsed, r.all_parse) for r in clean.date_parse_report(d, ["d1", "bad"]).collect()}
    assert rep == {"d1": (2, 2, True), "bad": (2, 1, False)}


def test_normalise_json_columns(spark):
    d = spark.createDataFrame([("{}", "[1]"), ("", "[]")], "j string, k string")
    out = clean.normalise_json(d, ["j", "k", "missing"])
    assert [tuple(r) for r in out.collect()] == [(None, "[1]"), (None, None)]


def test_dedup_null_equal_null(spark):
    d = spark.createDataFrame([("a", None), ("a", None), ("a", "b"), (None, None), (None, None)], "x string, y string")
    assert clean.dedup(d).count() == 3
    c = clean.dedup_counts(d).first()
    assert (c.rows_before, c.rows_after, c.duplicates_removed) == (5, 3, 2)
    # Idempotent.
    assert clean.dedup(clean.dedup(d)).count() == 3


def test_dedup_normalised_merges_null_and_empty(spark):
    d = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), (None, "x"), ("", "x")], "p string, q string")
    out = clean.dedup_normalised(d)
    # The two '|' rows stay apart (no joined-string collision); NULL and '' merge.
    assert out.count() == 3


def test_distinct_keys(spark):
    d = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (None, None)], "k long, p string")
    assert clean.distinct_keys(d, ["k", "p"]).count() == 3


def test_dedup_before_coercion_keeps_rows_that_differ_in_text(spark):
    # V9: rows differing only in unparseable text are distinct before coercion.
    d = spark.createDataFrame([("x",), ("y",)], "v string")
    assert clean.dedup(d).count() == 2
    assert clean.dedup(clean.coerce_numeric(d, ["v"])).count() == 1


def _mixed_rows(spark):
    rows = [(None, "a", 0.0), ("a", None, 0.0), ("a", None, -0.0), (None, None, None), (None, None, None), ("a", "b", float("nan")), ("a", "b", float("nan"))]
    rows += [(str(i % 40), "x" * (i % 7), float(i % 3)) for i in range(900)]
    return spark.createDataFrame(rows, "k string, t string, v double")


@pytest.mark.parametrize("bits", [128, 64, 5, 1])
@pytest.mark.parametrize("broadcast_rows", [clean.DIGESTS, 0])
def test_dedup_by_digest_equals_whole_rows(spark, bits, broadcast_rows):
    """Short digests collide; rows that share one are compared all the same."""
    d = _mixed_rows(spark)
    rows = lambda f: sorted(map(str, f.collect()))
    assert rows(clean.dedup_by_digest(d, bits, broadcast_rows)) == rows(clean.dedup(d))
    assert clean.dedup_counts_by_digest(d, bits).first() == clean.dedup_counts(d).first()


def test_dedup_by_digest_edges(spark):
    empty = spark.createDataFrame([], "a string, b int")
    assert clean.dedup_by_digest(empty).collect() == []
    assert tuple(clean.dedup_counts_by_digest(empty).first()) == (0, 0, 0)
    odd = spark.createDataFrame([("x", 1), ("x", 1)], "`a.b` string, `__digest2` int")
    assert clean.dedup_by_digest(odd).collect() == [("x", 1)]


def test_digest_dedup_shuffles_less_than_whole_rows(spark, tmp_path):
    """Wide rows, few copies: digests and the repeated rows move, the others stay."""
    wide = spark.range(2000).select(F.sha2(F.col("id").cast("string"), 512).alias("a"), F.repeat(F.sha2(F.concat(F.lit("z"), "id"), 512), 20).alias("b"))
    path = str(tmp_path / "wide")
    wide.unionAll(wide.limit(20)).write.parquet(path)
    d = spark.read.parquet(path)
    once = clean.dedup_by_digest(d)
    plan = once._jdf.queryExecution().executedPlan().toString()
    # One exchange by key, of the rows that share a digest; it stands above the semi join.
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.index("LeftAnti") < plan.index("Exchange hashpartitioning") < plan.index("LeftSemi")
    assert once.count() == 2000
