"""Whole-table and per-column profiles.

Numeric profiles are one single-row aggregate over all columns (a few
counters per column, no row explosion, one tiny shuffle of partial buffers),
unpivoted afterwards: one row per column even for an empty table. Quantiles
need the values themselves and use ``(column_name, position, value)`` rows
produced by ``inline`` (a codegen'd Generate).

Categorical profiles come from one frequency frame ``(column, value, n)``:
count, missing, distinct count and the most frequent value are all read from
it by a second, tiny aggregate. A hot value collapses to one row per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tablelens.functions.nulls import col_of
from tablelens.functions.numeric import mean_of, std_of, to_double, whole_stats
from tablelens.operators.ordering import global_rank, quantile_name, quantiles
from tablelens.operators.roles import ColumnRoles

DEFAULT_QUANTILES = (0.25, 0.5, 0.75)


def _long(d: DataFrame, cols: Sequence[str], value_type: str) -> DataFrame:
    types = {f.name: f.dataType for f in d.schema.fields}
    cells = []
    for i, c in enumerate(cols):
        value = to_double(c, types[c]) if value_type == "double" else col_of(c).cast("string")
        cells.append(
            F.struct(F.lit(c).alias("column_name"), F.lit(i).alias("position"), value.alias("value"))
        )
    return d.select(F.inline(F.array(*cells)))


def _names(d: DataFrame, cols: Sequence[str]) -> DataFrame:
    return d.sparkSession.createDataFrame(
        [(c, i) for i, c in enumerate(cols)], "column_name string, position int"
    )


def _overview_aggs(cols: Sequence[str]) -> list[Column]:
    return [F.count_if(col_of(c).isNull()).alias(f"_null{i}") for i, c in enumerate(cols)]


def dataset_overview(d: DataFrame, roles: ColumnRoles | None = None) -> DataFrame:
    """One row: rows, columns, roles, missing cells, missing %, columns with nulls."""
    return _overview_of(d.agg(F.count(F.lit(1)).alias("_rows"), *_overview_aggs(d.columns)), d.columns, roles)


def _overview_of(row: DataFrame, cols: Sequence[str], roles: ColumnRoles | None) -> DataFrame:
    missing = sum((F.col(f"_null{i}") for i in range(len(cols))), F.lit(0))
    with_nulls = sum(
        ((F.col(f"_null{i}") > 0).cast("long") for i in range(len(cols))), F.lit(0)
    )
    n_cols = len(cols)
    out = [
        F.col("_rows").cast("long").alias("row_count"),
        F.lit(n_cols).cast("long").alias("column_count"),
    ]
    if roles is not None:
        out += [
            F.lit(len(roles.numeric)).cast("long").alias("numeric_columns"),
            F.lit(len(roles.text)).cast("long").alias("text_columns"),
        ]
    out += [
        missing.cast("long").alias("missing_cells"),
        F.round(
            F.try_divide(F.lit(100.0) * missing, F.col("_rows") * F.lit(n_cols)), 1
        ).alias("missing_pct"),
        with_nulls.cast("long").alias("columns_with_nulls"),
    ]
    return row.select(*out)


def null_counts(d: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Per column: ``column_name, position, row_count, non_null, missing`` (A7, A8, A4 input)."""
    cols = list(cols if cols is not None else d.columns)
    aggs = [F.count(col_of(c)).alias(f"_c{i}") for i, c in enumerate(cols)]
    row = d.agg(F.count(F.lit(1)).alias("_rows"), *aggs)
    cells = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.lit(i).alias("position"),
            F.col("_rows").alias("row_count"),
            F.col(f"_c{i}").alias("non_null"),
        )
        for i, c in enumerate(cols)
    ]
    return row.select(F.inline(F.array(*cells))).withColumn(
        "missing", F.col("row_count") - F.col("non_null")
    )


def null_column_count(d: DataFrame) -> DataFrame:
    """One row: number of columns holding at least one NULL (A4)."""
    return null_counts(d).agg(
        F.count_if(F.col("missing") > 0).alias("columns_with_nulls"),
        F.count(F.lit(1)).alias("column_count"),
    )


def numeric_profile(
    d: DataFrame,
    cols: Sequence[str],
    ddof: int = 1,
    quantile_probs: Sequence[float] = (),
    decimals: int | None = None,
    exact_scale: int | None = None,
) -> DataFrame:
    """One row per numeric column: count, missing, mean, std, min, max [+ quantiles].

    Every column has a row, an all-null one with count 0 and NULL statistics
    (V23). ``ddof=1`` is the sample deviation (NULL for one value), ``ddof=0``
    the population deviation (V11, V12). Text cells are coerced with the
    numeric grammar, so this also profiles string columns typed numeric.
    ``exact_scale`` makes mean and deviation independent of task order
    (``mean_of``, ``std_of``). Doubles hold whole numbers up to 2^53 exactly;
    ``whole_number_profile`` has minimum, maximum and sum of larger ones.
    """
    cols = list(cols)
    row = _with_values(d, cols).agg(F.count(F.lit(1)).alias("_rows"), *_numeric_aggs(cols, ddof, exact_scale))
    out = _numeric_of(row, cols)
    if quantile_probs:
        out = with_quantiles(out, d, cols, quantile_probs)
    return out if decimals is None else _rounded(out, decimals, [quantile_name(p) for p in quantile_probs])


def whole_number_profile(d: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Per whole-number column: ``column_name, position, count, missing, mean, min, max, total``.

    All 64 bits count: minimum and maximum are bigints, the sum has 38 digits
    and the mean is that sum divided as a double. ``cols`` default to the
    columns with a whole-number type; others are refused.
    """
    kinds = {f.name: f.dataType for f in d.schema.fields}
    cols = [c for c, t in kinds.items() if isinstance(t, IntegralType)] if cols is None else list(cols)
    if odd := [c for c in cols if not isinstance(kinds[c], IntegralType)]:
        raise ValueError(f"not whole numbers: {odd}")
    if not cols:
        empty = "column_name string, position int, count bigint, missing bigint, mean double, min bigint, max bigint, total decimal(38,0)"
        return d.sparkSession.createDataFrame([], empty)
    aggs = []
    for i, c in enumerate(cols):
        low, high, total = whole_stats(c)
        aggs += [F.count(col_of(c)).alias(f"_n{i}"), low.alias(f"_lo{i}"), high.alias(f"_hi{i}"), total.alias(f"_t{i}")]
    cells = [
        F.struct(
            F.lit(c).alias("column_name"), F.lit(i).alias("position"), F.col(f"_n{i}").alias("count"),
            (F.col("_rows") - F.col(f"_n{i}")).alias("missing"),
            F.try_divide(F.col(f"_t{i}").cast("double"), F.col(f"_n{i}").cast("double")).alias("mean"),
            F.col(f"_lo{i}").alias("min"), F.col(f"_hi{i}").alias("max"), F.col(f"_t{i}").alias("total"),
        )
        for i, c in enumerate(cols)
    ]
    return d.agg(F.count(F.lit(1)).alias("_rows"), *aggs).select(F.inline(F.array(*cells)))


def with_quantiles(out: DataFrame, d: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """A numeric profile of ``cols`` of ``d`` with quantile columns."""
    if not cols:
        return out.withColumns({quantile_name(p): F.lit(None).cast("double") for p in probs})
    # Groups are the profiled columns: a bounded number, on both sides.
    q = quantiles(_long(d, list(cols), "double"), ["column_name"], "value", probs, few_groups=True)
    return out.join(F.broadcast(q), "column_name", "left")


def _rounded(out: DataFrame, decimals: int, more: Sequence[str] = ()) -> DataFrame:
    stats = [F.round(c, decimals).alias(c) for c in ["mean", "std", "min", "max", *more]]
    return out.select("column_name", "position", "count", "missing", *stats)


def overview_and_profile(
    d: DataFrame,
    roles: ColumnRoles,
    ddof: int = 1,
    decimals: int | None = None,
    exact_scale: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``dataset_overview`` and ``numeric_profile`` of the numeric columns from one scan.

    The scan runs when this is called; its single row of counters comes to the
    driver, and both frames are made of it.
    """
    cols = list(roles.numeric)
    aggs = [F.count(F.lit(1)).alias("_rows"), *_overview_aggs(d.columns), *_numeric_aggs(cols, ddof, exact_scale)]
    planned = _with_values(d, cols).agg(*aggs)
    row = d.sparkSession.createDataFrame(planned.collect(), planned.schema)
    out = _numeric_of(row, cols)
    return _overview_of(row, d.columns, roles), out if decimals is None else _rounded(out, decimals)


def _with_values(d: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``d`` with ``cols`` as doubles ``_v0, _v1, ...`` beside its own: below the aggregate, so each cell is converted once."""
    types = {f.name: f.dataType for f in d.schema.fields}
    return d.select("*", *[to_double(c, types[c]).alias(f"_v{i}") for i, c in enumerate(cols)])


def _numeric_aggs(cols: Sequence[str], ddof: int, exact_scale: int | None) -> list[Column]:
    """Aggregates of the columns of ``_with_values``."""
    if ddof not in (0, 1):
        raise ValueError("ddof must be 0 or 1")
    aggs = []
    for i in range(len(cols)):
        v = F.col(f"_v{i}")
        aggs += [
            F.count(v).alias(f"_n{i}"),
            mean_of(v, exact_scale).alias(f"_m{i}"),
            std_of(v, ddof, exact_scale).alias(f"_s{i}"),
            F.min(v).alias(f"_lo{i}"),
            F.max(v).alias(f"_hi{i}"),
        ]
    return aggs


def _numeric_of(row: DataFrame, cols: Sequence[str]) -> DataFrame:
    cells = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.lit(i).alias("position"),
            F.col(f"_n{i}").alias("count"),
            (F.col("_rows") - F.col(f"_n{i}")).alias("missing"),
            F.col(f"_m{i}").alias("mean"),
            F.col(f"_s{i}").alias("std"),
            F.col(f"_lo{i}").alias("min"),
            F.col(f"_hi{i}").alias("max"),
        )
        for i, c in enumerate(cols)
    ]
    if not cells:
        kinds = "column_name string, position int, count bigint, missing bigint, mean double, std double, min double, max double"
        return row.sparkSession.createDataFrame([], kinds)
    return row.select(F.inline(F.array(*cells)))


def _typed_frequencies(d: DataFrame, cols: Sequence[str], places: dict[str, int] | None = None) -> list[DataFrame]:
    """One frequency frame ``(column_name, position, value, n)`` per column type.

    Columns of one type are unpivoted together with their values kept typed,
    so a bigint id is hashed and shuffled as 8 bytes, not as text, and no
    timestamp is formatted per row. The NULL value has its own row.
    """
    by_type: dict[str, list[tuple[int, str]]] = {}
    for i, c in enumerate(cols):
        by_type.setdefault(d.schema[c].dataType.simpleString(), []).append((places[c] if places else i, c))
    frames = []
    for members in by_type.values():
        cells = [
            F.struct(F.lit(c).alias("column_name"), F.lit(i).alias("position"), col_of(c).alias("value"))
            for i, c in members
        ]
        long = d.select(F.inline(F.array(*cells)))
        frames.append(long.groupBy("column_name", "position", "value").agg(F.count(F.lit(1)).alias("n")))
    return frames


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def value_frequencies(d: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Frequency frame ``(column_name, position, value, n)``, the NULL value included.

    Counted on typed values (see ``_typed_frequencies``); ``value`` is cast to
    text only after aggregation, so the frames of all types can be unioned.
    """
    cols = list(cols)
    return _union(
        [
            f.select("column_name", "position", F.col("value").cast("string").alias("value"), "n")
            for f in _typed_frequencies(d, cols)
        ]
    )


#: Leading characters of a long text that are grouped and ordered as they are.
_HEAD = 64


def _digest_top(d: DataFrame, cols: list[tuple[int, str]]) -> tuple[DataFrame, DataFrame]:
    """Frequencies and top values of long text columns, grouped by digest.

    A value is grouped by its first characters and, if it is longer, a 256-bit
    digest, so whole texts are not shuffled as keys. The most frequent values
    with the smallest beginning are then fetched whole, and the smallest wins.
    """
    cells = F.inline(
        F.array(
            *[
                F.struct(F.lit(c).alias("column_name"), F.lit(i).alias("position"), col_of(c).alias("text"))
                for i, c in cols
            ]
        )
    )
    rows = d.select(cells).select(
        "column_name",
        "position",
        F.left("text", F.lit(_HEAD)).alias("value"),
        F.when(F.length("text") > _HEAD, F.unhex(F.sha2("text", 256))).alias("digest"),
        "text",
    )
    freq = rows.groupBy("column_name", "position", "value", "digest").agg(F.count(F.lit(1)).alias("n"))
    best = Window.partitionBy("column_name").orderBy(F.desc("n"), F.asc("value"), F.asc_nulls_first("digest"))
    first = freq.where("value IS NOT NULL").withColumn("_nth", F.row_number().over(best)).where("_nth = 1")
    first = first.select(F.col("column_name").alias("_c"), F.col("n").alias("_n"), F.col("value").alias("_v"), F.col("digest").alias("_d"))
    # One row per column is broadcast; values that tie with it share count and beginning.
    tied = freq.join(F.broadcast(first), (F.col("column_name") == F.col("_c")) & (F.col("n") == F.col("_n")) & (F.col("value") == F.col("_v")))
    tied = tied.where("_d IS NOT NULL AND digest IS NOT NULL").select(F.col("column_name").alias("_tc"), F.col("digest").alias("_td"))
    whole = rows.join(tied, (F.col("column_name") == F.col("_tc")) & (F.col("digest") == F.col("_td")), "left_semi")
    least = Window.partitionBy("column_name").orderBy("text")
    texts = whole.withColumn("_nth", F.row_number().over(least)).where("_nth = 1").select("column_name", "text")
    top = first.join(F.broadcast(texts), F.col("_c") == F.col("column_name"), "left").select(
        F.col("_c").alias("column_name"), F.coalesce("text", "_v").alias("top_value"), F.col("_n").alias("top_count")
    )
    return freq, top


def categorical_profile(
    d: DataFrame,
    cols: Sequence[str],
    max_cols: int | None = None,
    count_null_as_value: bool = False,
    long_text: Sequence[str] = (),
) -> DataFrame:
    """Per text column: count, missing, unique_count, top_value, top_count.

    The most frequent value ties to the smallest value in the column's own
    type order (V19); NULL is never the top value (V14); an all-null column
    gets zeros and a NULL top (A22). ``count_null_as_value`` adds one to
    ``unique_count`` for columns holding a NULL (A18, V13). ``top_value`` is
    text whatever the column type. String columns named in ``long_text`` are
    grouped by digest instead of by whole value, at the price of one more
    scan for the winning text.
    """
    cols = list(cols)[: max_cols if max_cols is not None else None]
    present = F.col("value").isNotNull()
    unique = F.count("value")
    if count_null_as_value:
        unique = unique + F.max((~present).cast("long"))

    def plain_top(freq: DataFrame) -> DataFrame:
        # Spark keeps one row per column and task before the shuffle (WindowGroupLimit).
        best = Window.partitionBy("column_name").orderBy(F.desc("n"), F.asc("value"))
        first = freq.where(present).withColumn("_nth", F.row_number().over(best)).where("_nth = 1")
        return first.select("column_name", F.col("value").cast("string").alias("top_value"), F.col("n").alias("top_count"))

    places = {c: i for i, c in enumerate(cols)}
    digested = [(i, c) for c, i in places.items() if c in set(long_text)]
    plain = [c for c in cols if c not in set(long_text)]
    pairs = [(f, plain_top(f)) for f in _typed_frequencies(d, plain, places)]
    if digested:
        pairs.append(_digest_top(d, digested))
    counts = [
        freq.groupBy("column_name", "position").agg(
            F.coalesce(F.sum(F.when(present, F.col("n"))), F.lit(0)).alias("count"),
            F.coalesce(F.sum(F.when(~present, F.col("n"))), F.lit(0)).alias("missing"),
            unique.alias("unique_count"),
        )
        for freq, _top in pairs
    ]
    # Every profiled column keeps a row, also for an empty table (A22, V23): counts and
    # top values, one row per profiled column each, are joined onto the list of names.
    prof = _names(d, cols).join(F.broadcast(_union(counts)), ["column_name", "position"], "left")
    prof = prof.join(F.broadcast(_union([top for _freq, top in pairs])), "column_name", "left")
    return prof.select(
        "column_name",
        "position",
        F.coalesce("count", F.lit(0)).cast("long").alias("count"),
        F.coalesce("missing", F.lit(0)).cast("long").alias("missing"),
        F.coalesce("unique_count", F.lit(0)).cast("long").alias("unique_count"),
        "top_value",
        F.coalesce("top_count", F.lit(0)).cast("long").alias("top_count"),
    )


def distinct_counts(
    d: DataFrame, cols: Sequence[str], count_null: bool = False, approx: bool = False
) -> DataFrame:
    """Per column: ``column_name, position, distinct_count`` (A17; A18 with ``count_null``).

    ``approx`` uses HyperLogLog++ (``approx_count_distinct``) for free text at scale.
    """
    cols = list(cols)
    if approx:
        aggs = []
        for i, c in enumerate(cols):
            e = F.approx_count_distinct(col_of(c))
            if count_null:
                e = e + F.max(col_of(c).isNull().cast("long"))
            aggs.append(e.alias(f"_d{i}"))
        row = d.agg(*aggs)
        cells = [
            F.struct(F.lit(c).alias("column_name"), F.lit(i).alias("position"), F.col(f"_d{i}").alias("distinct_count"))
            for i, c in enumerate(cols)
        ]
        return row.select(F.inline(F.array(*cells)))
    unique = F.count("value")
    if count_null:
        unique = unique + F.max(F.col("value").isNull().cast("long"))
    counts = _union(
        [
            freq.groupBy("column_name", "position").agg(unique.cast("long").alias("_dc"))
            for freq in _typed_frequencies(d, cols)
        ]
    )
    return _names(d, cols).join(F.broadcast(counts), ["column_name", "position"], "left").select(
        "column_name", "position", F.coalesce("_dc", F.lit(0)).cast("long").alias("distinct_count")
    )


def value_counts(d: DataFrame, col: str, dropna: bool = True, total: str = "rows") -> DataFrame:
    """``value, count, rank, pct`` for one column, ranked by count desc then value.

    ``pct`` is the share of all rows (``total="rows"``) or of non-null rows.
    The rank is computed with range partitioning, never in one task.
    """
    v = col_of(col)
    # One aggregate serves the counts and both denominators.
    all_counts = d.groupBy(v.alias("value")).agg(F.count(F.lit(1)).alias("count"))
    denom_src = all_counts if total == "rows" else all_counts.where(F.col("value").isNotNull())
    denom = denom_src.select(F.sum("count")).scalar()
    counts = all_counts.where(F.col("value").isNotNull()) if dropna else all_counts
    ranked = global_rank(counts, [F.desc("count"), F.asc_nulls_first("value")])
    return ranked.withColumn(
        "pct", F.round(F.try_divide(F.lit(100.0) * F.col("count"), denom), 1)
    )
