"""Column typing: thresholds (T1-T3, V2), schema typing (T4, V8), forced
text roles (T6, V25) and prefix samples (S7, V3)."""

from tablelens.operators.roles import (
    ColumnRoles,
    classify_by_schema,
    classify_columns,
    numeric_ratios,
    role_table,
)


def typing_frame(spark):
    # 10 rows: a 100 % numeric, b 80 %, c 90 %, d 0 %, e all NULL, f id-like numeric text.
    rows = []
    for i in range(10):
        rows.append(
            (
                i,
                str(i),
                "x" if i < 2 else str(i),
                "y" if i == 0 else f"{i}.5",
                f"w{i}",
                None,
                str(10**17 + i),
            )
        )
    return spark.createDataFrame(rows, "seq int, a string, b string, c string, d string, e string, f string")


def test_ratios(spark):
    r = {x.column_name: (x.non_null, x.numeric_count, x.ratio) for x in numeric_ratios(typing_frame(spark)).collect()}
    assert r["a"] == (10, 10, 1.0)
    assert r["b"] == (10, 8, 0.8)
    assert r["c"] == (10, 9, 0.9)
    assert r["d"] == (10, 0, 0.0)
    assert r["e"] == (0, 0, None)


def test_thresholds(spark):
    d = typing_frame(spark).drop("seq")
    unanimous = classify_columns(d, threshold=1.0, inclusive=True)
    assert unanimous.numeric == ("a", "f")
    inclusive = classify_columns(d, threshold=0.8, inclusive=True)
    assert inclusive.numeric == ("a", "b", "c", "f")
    strict = classify_columns(d, threshold=0.8, inclusive=False)
    assert strict.numeric == ("a", "c", "f")
    # An all-NULL column is text under every rule.
    assert "e" in strict.text and "e" in unanimous.text


def test_forced_text_and_ids(spark):
    d = typing_frame(spark).drop("seq")
    r = classify_columns(d, force_text=["c"], id_columns=["f"])
    assert r.numeric == ("a",)
    assert r.text == ("b", "c", "d", "e", "f")  # schema order kept (V4)
    table = {x.column_name: x.role for x in role_table(d, id_columns=["f"]).collect()}
    assert table["f"] == "text" and table["a"] == "numeric"


def test_prefix_samples(spark):
    d = typing_frame(spark)
    # First 2 rows by seq: b is 'x','x' -> 0 % numeric.
    r = {x.column_name: x.ratio for x in numeric_ratios(d, sample_rows=2, order_by="seq").collect()}
    assert r["b"] == 0.0 and r["a"] == 1.0
    # First 5 non-null values per column by seq: b has 2 of 5 bad.
    r = {x.column_name: x.ratio for x in numeric_ratios(d, sample_values=5, order_by="seq").collect()}
    assert r["b"] == 0.6 and r["c"] == 0.8


def test_schema_typing(spark):
    d = spark.createDataFrame([(1, 2.0, "a", True)], "i long, x double, s string, b boolean")
    assert classify_by_schema(d) == ColumnRoles(("i", "x"), ("s", "b"))
