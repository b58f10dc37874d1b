"""Column expressions: null tokens (S3, V1), numeric grammar (V5, V7), JSON (F7),
whitespace (P1) and display helpers (P11-P16)."""

import math

from pyspark.sql import functions as F

from tablelens.functions import (
    FOLDED_NULL_TOKENS,
    STRICT_NULL_TOKENS,
    WHITESPACE,
    composite_label,
    format_stat,
    json_canonical,
    json_kind,
    json_normalise,
    key_label,
    null_if_token,
    percent_of,
    short_label,
    strip_ws,
    to_double,
)


def one_col(spark, values, t="string"):
    return spark.createDataFrame([(v,) for v in values], f"v {t}")


def test_strict_tokens_case_sensitive_and_trimmed(spark):
    vals = ["null", "NULL", "Null", " NA ", "N/A", "n/a", "None", "none", "", "  ", "x"]
    out = one_col(spark, vals).select(null_if_token("v", STRICT_NULL_TOKENS, trim=True, fold_case=False).alias("o"))
    got = [r.o for r in out.collect()]
    assert got == [None, None, "Null", None, None, "n/a", None, "none", None, None, "x"]


def test_folded_tokens_lowercase(spark):
    vals = ["NaN", "#N/A", "#NULL!", "Undefined", " None ", "value", "nan1"]
    out = one_col(spark, vals).select(null_if_token("v", FOLDED_NULL_TOKENS).alias("o"))
    assert [r.o for r in out.collect()] == [None, None, None, None, None, "value", "nan1"]


def test_untrimmed_policy_keeps_padded_token(spark):
    out = one_col(spark, [" NA", "NA"]).select(null_if_token("v", STRICT_NULL_TOKENS, trim=False, fold_case=False).alias("o"))
    assert [r.o for r in out.collect()] == [" NA", None]


def test_strip_removes_unicode_whitespace(spark):
    out = one_col(spark, ["  a b\t\n", "　x "]).select(strip_ws("v").alias("o"))
    assert [r.o for r in out.collect()] == ["a b", "x"]
    assert all(ch.isspace() for ch in WHITESPACE) and " " in WHITESPACE


def test_numeric_grammar(spark):
    cases = {
        "12": 12.0, " 12 ": 12.0, "1e5": 1e5, ".5": 0.5, "3.": 3.0, "+2": 2.0, "-1.5E-2": -0.015,
        "inf": math.inf, "-Infinity": -math.inf,
        "1_000": None, "1d": None, "nan": None, "1,000": None, "abc": None, "": None, None: None,
    }
    out = one_col(spark, list(cases)).select("v", to_double("v").alias("o")).collect()
    for r in out:
        assert r.o == cases[r.v], r


def test_nan_of_numeric_column_is_null(spark):
    df = spark.createDataFrame([(1.5,), (float("nan"),), (None,)], "v double")
    got = [r.o for r in df.select(to_double("v", df.schema["v"].dataType).alias("o")).collect()]
    assert got == [1.5, None, None]


def test_json_normalise_and_kind(spark):
    vals = ['{"a":1}', "[1,2]", "{}", "[]", "", "plain", "{bad", "['a']", None]
    out = one_col(spark, vals).select(
        json_normalise("v").alias("n"), json_kind("v").alias("k"), json_canonical("v").alias("c")
    ).collect()
    assert [r.n for r in out] == ['{"a":1}', "[1,2]", None, None, None, "plain", "{bad", "['a']", None]
    assert [r.k for r in out] == ["json", "json", "null", "null", "null", "text", "invalid", "invalid", "null"]
    assert out[0].c == '{"a":1}' and out[6].c == "{bad"


def test_display_helpers(spark):
    df = spark.createDataFrame(
        [(1234567.0, "abcdefghijklmnopqrstuvwxyz", None, 5), (2.675, "short", "k", 0), (None, None, "z", 3)],
        "x double, s string, k string, n int",
    )
    out = df.select(
        format_stat("x").alias("f"),
        short_label("s", 20).alias("l"),
        short_label("s", 5, ellipsis=False).alias("l2"),
        key_label("k").alias("k"),
        composite_label(["k", "n"]).alias("c"),
        percent_of("n", F.lit(8)).alias("p"),
    ).collect()
    # Formatting rounds the binary value, as Python's f"{2.675:,.2f}" does.
    assert [r.f for r in out] == ["1,234,567", f"{2.675:,.2f}", "None"]
    assert [r.l for r in out] == ["abcdefghijklmnopqrst...", "short", None]
    assert [r.l2 for r in out] == ["abcde", "short", None]
    assert [r.k for r in out] == ["None", "k", "z"]
    assert [r.c for r in out] == ["None+1more", "k+1more", "z+1more"]
    assert [r.p for r in out] == [62.5, 0.0, 37.5]
