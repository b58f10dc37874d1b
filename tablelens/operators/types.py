"""Types of text columns in one scan.

One aggregate counts, for every column, the cells that read as booleans, whole
numbers, numbers, dates, times and JSON objects or arrays. The column's kind is the
join of its cells' kinds in a small lattice: a whole number is a number, a date
is a time (its midnight), any two others only share text.

                       text
      /       |          |          |
   number    time     boolean     json
     |        |
   whole     date
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType,
    DataType,
    DateType,
    IntegralType,
    NumericType,
    StringType,
    TimestampNTZType,
    TimestampType,
)

from tablelens.functions.nulls import col_of, strip_ws
from tablelens.functions.numeric import parses_as_number, to_double
from tablelens.operators.clean import DEFAULT_DATE_FORMATS

#: Kinds whose cells are counted, each before those that hold it.
KINDS = ("boolean", "whole", "number", "date", "time", "json")
_WHOLE = r"^[+-]?\d{1,18}$"
_DAY = r"^\d{4}-\d{2}-\d{2}$"


def _tests(c: str, kind: DataType, formats: Sequence[str]) -> dict[str, Column]:
    """For each kind, whether a cell reads as it."""
    own = {
        BooleanType: ("boolean",), IntegralType: ("whole", "number"), NumericType: ("number",),
        DateType: ("date", "time"), TimestampType: ("time",), TimestampNTZType: ("time",),
    }
    if not isinstance(kind, StringType):
        held = next((kinds for t, kinds in own.items() if isinstance(kind, t)), ())
        return {k: col_of(c).isNotNull() & F.lit(k in held) for k in KINDS}
    v = strip_ws(c)
    time = F.coalesce(*[F.try_to_timestamp(v, F.lit(f)) for f in formats]).isNotNull()
    return {
        "boolean": F.lower(v).isin("true", "false"),
        "whole": v.rlike(_WHOLE),
        "number": parses_as_number(c),
        "date": v.rlike(_DAY) & time,
        "time": time,
        "json": F.substring(v, 1, 1).isin("{", "[") & F.try_parse_json(v).isNotNull(),
    }


def type_counts(d: DataFrame, cols: Sequence[str] | None = None, formats: Sequence[str] = DEFAULT_DATE_FORMATS) -> DataFrame:
    """Per column: ``column_name, position, non_null`` and ``n_<kind>`` for each kind; one single-row aggregate."""
    cols = list(cols if cols is not None else d.columns)
    kinds = {f.name: f.dataType for f in d.schema.fields}
    aggs, cells = [], []
    for i, c in enumerate(cols):
        tests = _tests(c, kinds[c], formats)
        aggs += [F.count(col_of(c)).alias(f"_n{i}"), *[F.count_if(t).alias(f"_{k}{i}") for k, t in tests.items()]]
        counts = [F.col(f"_{k}{i}").alias(f"n_{k}") for k in KINDS]
        cells.append(F.struct(F.lit(c).alias("column_name"), F.lit(i).alias("position"), F.col(f"_n{i}").alias("non_null"), *counts))
    if not cells:
        empty = ", ".join(f"n_{k} bigint" for k in KINDS)
        return d.sparkSession.createDataFrame([], f"column_name string, position int, non_null bigint, {empty}")
    return d.agg(*aggs).select(F.inline(F.array(*cells)))


def type_table(
    d: DataFrame,
    cols: Sequence[str] | None = None,
    threshold: float = 1.0,
    force_text: Sequence[str] = (),
    formats: Sequence[str] = DEFAULT_DATE_FORMATS,
) -> DataFrame:
    """``type_counts`` plus ``kind`` and ``role`` (``numeric`` or ``text``).

    ``kind`` is the first of boolean, whole, number, date, time and json as
    which at least ``threshold`` of the column's non-null cells read, else
    text; ``empty`` without cells. Columns in ``force_text`` are text.
    """
    counts = type_counts(d, cols, formats)
    kind = F.when(F.col("non_null") == 0, "empty")
    if force_text:
        kind = F.when(F.col("column_name").isin(*force_text), "text").when(F.col("non_null") == 0, "empty")
    for k in KINDS:
        kind = kind.when(F.col(f"n_{k}") >= F.col("non_null") * F.lit(threshold), k)
    kind = kind.otherwise("text")
    role = F.when(F.col("kind").isin("whole", "number"), "numeric").otherwise("text")
    return counts.withColumn("kind", kind).withColumn("role", role)


def kinds_of(d: DataFrame, **how) -> dict[str, str]:
    """Column kinds in schema order (one aggregate job, one row for each column collected)."""
    found = {r["column_name"]: r["kind"] for r in type_table(d, **how).select("column_name", "kind").collect()}
    return {c: found[c] for c in d.columns if c in found}


def cast_kinds(d: DataFrame, kinds: Mapping[str, str], formats: Sequence[str] = DEFAULT_DATE_FORMATS) -> DataFrame:
    """Text columns cast to their kinds; cells that do not read as theirs become NULL. Json and text stay text."""
    types = {f.name: f.dataType for f in d.schema.fields}

    def cast(c: str) -> Column:
        kind, v = kinds.get(c, "text"), strip_ws(c)
        if not isinstance(types[c], StringType) or kind in ("text", "json", "empty"):
            return col_of(c)
        if kind == "boolean":
            return F.when(F.lower(v).isin("true", "false"), F.lower(v) == "true")
        if kind == "whole":
            return F.when(v.rlike(_WHOLE), v.try_cast("bigint"))
        if kind == "number":
            return to_double(c, types[c])
        time = F.coalesce(*[F.try_to_timestamp(v, F.lit(f)) for f in formats]).cast("timestamp_ntz")
        return F.when(v.rlike(_DAY), time).cast("date") if kind == "date" else time

    return d.select(*[cast(c).alias(c) for c in d.columns])
