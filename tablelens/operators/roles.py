"""Column roles: which columns are numeric and which are text.

Roles decide which statistics apply, so they are computed once, in one
aggregate over all columns, and passed to the profile functions as a
``ColumnRoles`` value. ``numeric_ratios`` is the distributed part; only its
one-row-per-column result reaches the driver in ``classify_columns``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType

from tablelens.functions.nulls import col_of
from tablelens.functions.numeric import parses_as_number


@dataclass(frozen=True)
class ColumnRoles:
    numeric: tuple[str, ...] = field(default_factory=tuple)
    text: tuple[str, ...] = field(default_factory=tuple)

    def first_numeric(self, k: int) -> list[str]:
        return list(self.numeric[:k])

    def first_text(self, k: int) -> list[str]:
        return list(self.text[:k])


def classify_by_schema(d: DataFrame) -> ColumnRoles:
    """Numeric iff the physical type is numeric (T4). Booleans are text (V8)."""
    numeric, text = [], []
    for f in d.schema.fields:
        is_num = isinstance(f.dataType, NumericType) and not isinstance(f.dataType, BooleanType)
        (numeric if is_num else text).append(f.name)
    return ColumnRoles(tuple(numeric), tuple(text))


def numeric_flag(d: DataFrame, c: str) -> Column:
    """True where a cell counts as numeric: any value of a numeric column, a
    text cell matching the numeric grammar, never a date or boolean."""
    t = d.schema[c].dataType
    if isinstance(t, NumericType):
        return col_of(c).isNotNull()
    if isinstance(t, StringType):
        return parses_as_number(c)
    return F.lit(False)


def ratio_aggregates(d: DataFrame, cols: Sequence[str]) -> list[Column]:
    """The two counters per column behind the ratios: ``_n<i>`` non-null and
    ``_k<i>`` numeric cells. Usable in ``agg`` or in ``observe``."""
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.count(col_of(c)).alias(f"_n{i}"), F.count_if(numeric_flag(d, c)).alias(f"_k{i}")]
    return aggs


def roles_from_counts(
    cols: Sequence[str],
    counts: dict,
    threshold: float = 0.8,
    inclusive: bool = False,
    force_text: Sequence[str] = (),
    id_columns: Sequence[str] = (),
) -> ColumnRoles:
    """Roles from the ``ratio_aggregates`` counters (same rule as ``role_expr``)."""
    forced = set(force_text) | set(id_columns)
    numeric, text = [], []
    for i, c in enumerate(cols):
        n, k = counts[f"_n{i}"] or 0, counts[f"_k{i}"] or 0
        ratio = k / n if n else None
        ok = ratio is not None and (ratio >= threshold if inclusive else ratio > threshold)
        (numeric if ok and c not in forced else text).append(c)
    return ColumnRoles(tuple(numeric), tuple(text))


def numeric_ratios(
    d: DataFrame,
    cols: Sequence[str] | None = None,
    sample_values: int | None = None,
    sample_rows: int | None = None,
    order_by: str | Column | None = None,
) -> DataFrame:
    """Per column: ``column_name, position, non_null, numeric_count, ratio``.

    Default: every row, independent of row order (V3), in one single-row
    aggregate (two counters per column, no row explosion). ``sample_rows``
    keeps the first rows by ``order_by``; ``sample_values`` keeps the first
    non-null values of each column by ``order_by`` (the reference's prefix
    samples). Numeric columns count every value as numeric; other non-text
    types (dates, booleans) count none; only text is matched against the
    numeric grammar.
    """
    cols = list(cols if cols is not None else d.columns)
    if (sample_rows or sample_values) and order_by is None:
        raise ValueError("a prefix sample needs order_by: Spark rows have no inherent order")
    base = d
    if sample_rows:
        # A top-k by an explicit order: TakeOrderedAndProject, k rows at most per task.
        base = base.orderBy(col_of(order_by)).limit(sample_rows)
    def is_num(c: str) -> Column:
        return numeric_flag(d, c)

    if sample_values:
        cells = [
            F.struct(
                F.lit(c).alias("column_name"),
                F.lit(i).alias("position"),
                col_of(c).isNotNull().alias("present"),
                is_num(c).alias("is_num"),
            )
            for i, c in enumerate(cols)
        ]
        long = base.select(col_of(order_by).alias("_ord"), F.inline(F.array(*cells))).where("present")
        w = Window.partitionBy("column_name").orderBy("_ord")
        long = long.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= sample_values)
        counted = long.groupBy("column_name", "position").agg(
            F.count(F.lit(1)).alias("non_null"),
            F.count_if(F.col("is_num")).alias("numeric_count"),
        )
        names = d.sparkSession.createDataFrame(
            [(c, i) for i, c in enumerate(cols)], "column_name string, position int"
        )
        # All-null columns keep a row (non_null 0): join the fixed list of names.
        counted = F.broadcast(names).join(counted, ["column_name", "position"], "left")
    else:
        row = base.agg(*ratio_aggregates(d, cols))
        counted = row.select(
            F.inline(
                F.array(
                    *[
                        F.struct(
                            F.lit(c).alias("column_name"),
                            F.lit(i).alias("position"),
                            F.col(f"_n{i}").alias("non_null"),
                            F.col(f"_k{i}").alias("numeric_count"),
                        )
                        for i, c in enumerate(cols)
                    ]
                )
            )
        )
    return counted.select(
        "column_name",
        "position",
        F.coalesce("non_null", F.lit(0)).cast("long").alias("non_null"),
        F.coalesce("numeric_count", F.lit(0)).cast("long").alias("numeric_count"),
        F.try_divide(F.col("numeric_count").cast("double"), F.col("non_null")).alias("ratio"),
    )


def role_expr(threshold: float = 0.8, inclusive: bool = False) -> Column:
    """``numeric`` / ``text`` from a ratio column; no values means text."""
    r = F.col("ratio")
    passed = (r >= threshold) if inclusive else (r > threshold)
    return F.when(F.col("non_null") > 0, F.when(passed, "numeric").otherwise("text")).otherwise(
        "text"
    )


def role_of_ratios(
    ratios: DataFrame, threshold: float = 0.8, inclusive: bool = False, forced: Sequence[str] = ()
) -> DataFrame:
    """``numeric_ratios`` rows plus a ``role``; ``forced`` columns are text."""
    role = role_expr(threshold, inclusive)
    if forced:
        role = F.when(F.col("column_name").isin(*forced), F.lit("text")).otherwise(role)
    return ratios.withColumn("role", role)


def role_table(
    d: DataFrame,
    threshold: float = 0.8,
    inclusive: bool = False,
    force_text: Sequence[str] = (),
    id_columns: Sequence[str] = (),
    **sample,
) -> DataFrame:
    """``numeric_ratios`` plus a ``role`` column."""
    return role_of_ratios(numeric_ratios(d, **sample), threshold, inclusive, sorted(set(force_text) | set(id_columns)))


def classify_columns(
    d: DataFrame,
    threshold: float = 0.8,
    inclusive: bool = False,
    force_text: Sequence[str] = (),
    id_columns: Sequence[str] = (),
    **sample,
) -> ColumnRoles:
    """Roles in schema order (V4). One aggregate job; ``len(columns)`` rows collected.

    Presets: unanimous ``threshold=1.0, inclusive=True`` (T1); ratio at least
    0.8 ``inclusive=True`` (T2); ratio above 0.8, the default (T3).
    """
    rows = role_table(d, threshold, inclusive, force_text, id_columns, **sample).select(
        "column_name", "role"
    ).collect()
    role = {r["column_name"]: r["role"] for r in rows}
    numeric = tuple(c for c in d.columns if role.get(c) == "numeric")
    text = tuple(c for c in d.columns if role.get(c) == "text")
    return ColumnRoles(numeric, text)
