"""Group sizes, top groups, drill-downs and grouped statistics.

Ordering rule for every "top" or "first" result (V19): the measure
descending, then the keys ascending with NULL first, so results do not depend
on partitioning. NULL keys form a group unless ``drop_null_keys`` (G2, G3).

Top-k results use ``orderBy(...).limit(k)``, which plans as
``TakeOrderedAndProject``: each task keeps its own k best rows and only those
meet in one place. Ranks 1..k are numbered after the limit, on k rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablelens.functions.display import composite_label
from tablelens.functions.nulls import col_of
from tablelens.functions.numeric import mean_of, to_double
from tablelens.operators.ordering import global_rank, quantile_name, quantiles

SIZE = "size"


def _keys(keys: Sequence[str] | str) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def require_columns(d: DataFrame, cols: Sequence[str]) -> None:
    """Raise ``ValueError`` naming missing columns."""
    missing = [c for c in cols if c not in d.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def _drop_nulls(d: DataFrame, keys: list[str], drop_null_keys: bool) -> DataFrame:
    if not drop_null_keys:
        return d
    cond = None
    for k in keys:
        c = col_of(k).isNotNull()
        cond = c if cond is None else cond & c
    return d.where(cond)


def key_order(keys: Sequence[str]) -> list[Column]:
    return [F.asc_nulls_first(col_of(k)) for k in keys]


def rank_rows(top: DataFrame, order: Sequence[Column], rank_col: str = "rank") -> DataFrame:
    """Number the rows of an already limited (k-row) frame 1..k."""
    return top.withColumn(rank_col, F.row_number().over(Window.orderBy(*order)).cast("long"))


def group_sizes(
    d: DataFrame, keys: Sequence[str] | str, drop_null_keys: bool = False
) -> DataFrame:
    """``keys..., size`` for every group."""
    keys = _keys(keys)
    require_columns(d, keys)
    base = _drop_nulls(d, keys, drop_null_keys)
    return base.groupBy(*[col_of(k) for k in keys]).agg(F.count(F.lit(1)).alias(SIZE))


def ranked_group_sizes(
    d: DataFrame, keys: Sequence[str] | str, drop_null_keys: bool = False
) -> DataFrame:
    """Every group with its size and rank 1..n, largest first, keys ascending
    with NULL first (W2, V19). Ranks come from ``global_rank`` (range
    partitioned), so millions of groups never meet in one task."""
    keys = _keys(keys)
    sizes = group_sizes(d, keys, drop_null_keys)
    ranked = global_rank(sizes, [F.desc(SIZE), *key_order(keys)])
    return ranked.select("rank", *keys, SIZE)


def group_sizes_multi(d: DataFrame, key_sets: Sequence[Sequence[str]]) -> DataFrame:
    """Sizes for several key lists in one ``GROUPING SETS`` aggregate.

    Output: ``key_set`` (the key names joined by ``,``), every key column (NULL
    where aggregated away), ``grouping_id`` and ``size``. ``grouping_id`` tells
    a real NULL key from an aggregated-away one.
    """
    key_sets = [_keys(ks) for ks in key_sets]
    all_keys: list[str] = []
    for ks in key_sets:
        for k in ks:
            if k not in all_keys:
                all_keys.append(k)
    require_columns(d, all_keys)
    agg = d.groupingSets(
        [[col_of(k) for k in ks] for ks in key_sets], *[col_of(k) for k in all_keys]
    ).agg(F.count(F.lit(1)).alias(SIZE), F.grouping_id().alias("grouping_id"))
    n = len(all_keys)
    label = F.lit(None).cast("string")
    for ks in key_sets:
        gid = sum(1 << (n - 1 - i) for i, k in enumerate(all_keys) if k not in ks)
        label = F.when(F.col("grouping_id") == gid, F.lit(",".join(ks))).otherwise(label)
    return agg.select(label.alias("key_set"), *all_keys, "grouping_id", SIZE)


def group_size_stats(
    d: DataFrame,
    keys: Sequence[str] | str,
    drop_null_keys: bool = False,
    quantile_probs: Sequence[float] = (0.25, 0.5, 0.75),
) -> DataFrame:
    """One row describing group sizes: count, mean, std, min, quartiles, max.

    Quartiles are exact (``percentile``, linear interpolation). Its value map
    is bounded: group sizes sum to the row count N, so there are at most
    sqrt(2N) distinct sizes (1.4 million for 10^12 rows), whatever the data.
    """
    return size_stats_of(group_sizes(d, keys, drop_null_keys), quantile_probs)


def size_stats_of(sizes: DataFrame, quantile_probs: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """``group_size_stats`` from a frame that already has a ``size`` column per group."""
    aggs = [
        F.count(F.lit(1)).alias("group_count"),
        F.coalesce(F.sum(SIZE), F.lit(0)).cast("long").alias("row_count"),
        F.avg(SIZE).alias("mean_size"),
        F.stddev_samp(SIZE).alias("std_size"),
        F.min(SIZE).alias("min_size"),
        F.max(SIZE).alias("max_size"),
    ]
    if quantile_probs:
        aggs.append(F.percentile(F.col(SIZE), [float(p) for p in quantile_probs]).alias("_q"))
    stats = sizes.agg(*aggs)
    if not quantile_probs:
        return stats
    return stats.select(
        *[c for c in stats.columns if c != "_q"],
        *[F.col("_q")[i].alias(quantile_name(p)) for i, p in enumerate(quantile_probs)],
    )


def top_groups(
    d: DataFrame,
    keys: Sequence[str] | str,
    k: int = 10,
    drop_null_keys: bool = False,
    null_label: str = "None",
) -> DataFrame:
    """``rank, keys..., size, label`` of the k largest groups."""
    keys = _keys(keys)
    return top_of(group_sizes(d, keys, drop_null_keys), keys, k, null_label)


def top_of(sizes: DataFrame, keys: Sequence[str] | str, k: int = 10, null_label: str = "None") -> DataFrame:
    """``top_groups`` from a frame that already has ``keys..., size`` per group."""
    keys = _keys(keys)
    order = [F.desc(SIZE), *key_order(keys)]
    top = sizes.orderBy(*order).limit(k)
    return rank_rows(top, order).select(
        "rank", *keys, SIZE, composite_label(keys, null_label).alias("label")
    )


def _values(d: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """The keys, and ``cols`` as doubles ``_v0, _v1, ...``: a projection below the aggregate, so each cell is converted once."""
    types = {f.name: f.dataType for f in d.schema.fields}
    return d.select(*[col_of(k) for k in keys], *[to_double(c, types[c]).alias(f"_v{i}") for i, c in enumerate(cols)])


def _numeric_aggs(cols: Sequence[str], exact_scale: int | None = None) -> list[Column]:
    """Aggregates of the columns of ``_values``."""
    aggs = []
    for i in range(len(cols)):
        v = F.col(f"_v{i}")
        aggs += [
            F.count(v).alias(f"_n{i}"),
            mean_of(v, exact_scale).alias(f"_a{i}"),
            F.min(v).alias(f"_lo{i}"),
            F.max(v).alias(f"_hi{i}"),
        ]
    return aggs


def _numeric_cells(cols: Sequence[str]) -> Column:
    return F.inline(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("column_name"),
                    F.lit(i).alias("position"),
                    F.col(f"_n{i}").alias("count"),
                    F.col(f"_a{i}").alias("mean"),
                    F.col(f"_lo{i}").alias("min"),
                    F.col(f"_hi{i}").alias("max"),
                )
                for i, c in enumerate(cols)
            ]
        )
    )


def restrict_to_groups(d: DataFrame, groups: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """Rows of ``d`` whose key (NULL-safe) is among ``groups``.

    ``groups`` must be a top-k frame: it is limited to ``k`` rows here, which
    is what makes broadcasting it safe whatever the size of ``d``.
    """
    keys = _keys(keys)
    small = groups.select(*[col_of(k_).alias(f"_k{i}") for i, k_ in enumerate(keys)]).limit(k)
    cond = None
    for i, k_ in enumerate(keys):
        c = col_of(k_).eqNullSafe(F.col(f"_k{i}"))
        cond = c if cond is None else cond & c
    return d.join(F.broadcast(small), cond, "left_semi")


def top_group_drilldown(
    d: DataFrame,
    keys: Sequence[str] | str,
    cols: Sequence[str],
    k: int = 3,
    max_cols: int | None = None,
    method: str = "single_pass",
    drop_null_keys: bool = False,
    exact_scale: int | None = None,
) -> DataFrame:
    """Mean/min/max of numeric columns in the k largest groups.

    All of ``cols``, or the first ``max_cols`` of them if given (P7).

    Output, one row per (group, column): ``rank, keys..., size, column_name,
    position, count, mean, min, max``. The NULL group is a group (V17).

    ``single_pass`` (default) computes size and statistics for every group in
    one aggregate and keeps the k largest: one scan, one shuffle of partial
    aggregates. ``semi_join`` first finds the k largest groups, then
    broadcasts those k keys into a semi-join and aggregates only their rows;
    it scans twice but shuffles only the top groups' partials.
    """
    keys = _keys(keys)
    cols = list(cols)[:max_cols]
    require_columns(d, keys + cols)
    base = _drop_nulls(d, keys, drop_null_keys)
    order = [F.desc(SIZE), *key_order(keys)]
    if method == "single_pass":
        return drilldown_of(group_table(base, keys, cols, exact_scale=exact_scale), keys, cols, k)
    elif method == "semi_join":
        sizes = group_sizes(base, keys).orderBy(*order).limit(k)
        rows = restrict_to_groups(base, sizes, keys, k)
        top = _values(rows, keys, cols).groupBy(*[col_of(k_) for k_ in keys]).agg(
            F.count(F.lit(1)).alias(SIZE), *_numeric_aggs(cols, exact_scale)
        )
    else:
        raise ValueError(f"unknown method {method!r}")
    return rank_rows(top, order).select("rank", *keys, SIZE, _numeric_cells(cols))


def group_table(
    d: DataFrame,
    keys: Sequence[str] | str,
    cols: Sequence[str] = (),
    drop_null_keys: bool = False,
    exact_scale: int | None = None,
) -> DataFrame:
    """One row per group: ``keys..., size`` and count/mean/min/max of ``cols``.

    The shared input of ``size_stats_of``, ``top_of`` and ``drilldown_of``: a
    caller that wants all three computes (and may persist) it once.
    """
    keys = _keys(keys)
    cols = list(cols)
    require_columns(d, keys + cols)
    base = _drop_nulls(d, keys, drop_null_keys)
    return _values(base, keys, cols).groupBy(*[col_of(k_) for k_ in keys]).agg(
        F.count(F.lit(1)).alias(SIZE), *_numeric_aggs(cols, exact_scale)
    )


def drilldown_of(table: DataFrame, keys: Sequence[str] | str, cols: Sequence[str], k: int = 3) -> DataFrame:
    """``top_group_drilldown`` from a ``group_table`` built with the same ``cols``."""
    keys = _keys(keys)
    order = [F.desc(SIZE), *key_order(keys)]
    top = table.orderBy(*order).limit(k)
    return rank_rows(top, order).select("rank", *keys, SIZE, _numeric_cells(list(cols)))


def grouped_numeric_stats(
    d: DataFrame,
    keys: Sequence[str] | str,
    cols: Sequence[str],
    k: int = 10,
    max_cols: int | None = None,
    exact_scale: int | None = None,
) -> DataFrame:
    """Per numeric column, the k groups with most values: mean/min/max/count.

    One aggregate computes all columns for every group; the per-column top-k
    uses ``row_number() <= k``, which Spark plans with a partial
    ``WindowGroupLimit`` before the shuffle, so each column's window sees at
    most k rows per map task. Output: ``column_name, position, rank, keys...,
    count, mean, min, max``.
    """
    keys = _keys(keys)
    cols = list(cols)[:max_cols]
    require_columns(d, keys + cols)
    stats = _values(d, keys, cols).groupBy(*[col_of(k_) for k_ in keys]).agg(*_numeric_aggs(cols, exact_scale))
    long = stats.select(*keys, _numeric_cells(cols)).where(F.col("count") > 0)
    w = Window.partitionBy("column_name").orderBy(F.desc("count"), *key_order(keys))
    return (
        long.withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k)
        .select("column_name", "position", F.col("rank").cast("long").alias("rank"), *keys, "count", "mean", "min", "max")
    )


def first_groups(
    d: DataFrame,
    keys: Sequence[str] | str,
    order_by: str,
    k: int = 10,
    cols: Sequence[str] = (),
    max_cols: int | None = None,
    exact_scale: int | None = None,
) -> DataFrame:
    """The k groups that appear first by ``order_by``, with row count and means.

    Output: ``rank, keys..., first_seen, row_count`` and ``<col>_mean``,
    ``<col>_count`` for ``cols`` (the first ``max_cols`` if given). One aggregate and a
    top-k: the reference's one-filter-per-group loop becomes one pass.
    """
    keys = _keys(keys)
    cols = list(cols)[:max_cols]
    require_columns(d, keys + cols + [order_by])
    types = {f.name: f.dataType for f in d.schema.fields}
    aggs = [F.min(col_of(order_by)).alias("first_seen"), F.count(F.lit(1)).alias("row_count")]
    for c in cols:
        v = to_double(c, types[c])
        aggs += [mean_of(v, exact_scale).alias(f"{c}_mean"), F.count(v).alias(f"{c}_count")]
    order = [F.asc("first_seen"), *key_order(keys)]
    top = d.groupBy(*[col_of(k_) for k_ in keys]).agg(*aggs).orderBy(*order).limit(k)
    out = rank_rows(top, order)
    stat_cols = [n for c in cols for n in (f"{c}_mean", f"{c}_count")]
    return out.select("rank", *keys, "first_seen", "row_count", *stat_cols)


#: Relative error of the distinct sketch, and the registers it has at that.
_RSD, _REGISTERS = 0.05, 1 << 9


def grouping_candidates(
    d: DataFrame,
    cols: Sequence[str],
    exclude: Sequence[str] = (),
    lo: int = 2,
    hi: int = 20,
    max_cols: int | None = None,
    sample_rows: int | None = None,
    order_by: str | Sequence[str] | None = None,
) -> DataFrame:
    """Text columns usable as a grouping key: ``lo`` to ``hi`` distinct non-null values.

    Looks at ``cols`` (the first ``max_cols`` if given) without those in
    ``exclude``. ``sample_rows`` judges by the first rows in ``order_by``
    instead of by all rows (V24). Output: ``column_name, position,
    unique_count, choice`` where ``choice`` 1 is the best candidate (fewest
    distinct values, ties by column order).

    The decision is exact, and no job runs before the frame is read. A sketch
    of all columns, one scan and one small row, spares columns with many values
    the shuffle of them: below its linear range a HyperLogLog counts at most
    ``m * ln(m / (m - n))`` for n values in m registers, so a column whose
    estimate is above that of ``hi`` has more than ``hi`` values. The values of
    all other columns are counted.
    """
    chosen = [(i, c) for i, c in enumerate(list(cols)[:max_cols]) if c not in set(exclude)]
    if sample_rows is not None:
        if order_by is None:
            raise ValueError("sample_rows needs order_by: rows have no order of their own")
        d = first_rows(d, order_by, sample_rows)
    if not chosen:
        return d.sparkSession.createDataFrame([], "column_name string, position int, unique_count long, choice long")
    most = math.ceil(_REGISTERS * math.log(_REGISTERS / (_REGISTERS - hi))) if hi < _REGISTERS // 4 else None
    values = [col_of(c).cast("string") for _, c in chosen]
    if most is not None:
        estimates = d.agg(F.array(*[F.approx_count_distinct(col_of(c), _RSD) for _, c in chosen]).alias("n")).scalar()
        values = [F.when(F.get(estimates, F.lit(k)) <= F.lit(most), v) for k, v in enumerate(values)]
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), F.lit(i).alias("position"), v.alias("value"))
            for (i, c), v in zip(chosen, values, strict=True)
        ]
    )
    distinct = d.select(F.inline(cells)).where(F.col("value").isNotNull()).distinct()
    counts = distinct.groupBy("column_name", "position").agg(
        F.count(F.lit(1)).alias("unique_count")
    )
    ok = counts.where((F.col("unique_count") >= lo) & (F.col("unique_count") <= hi))
    # One row per column: the window runs on a bounded frame.
    w = Window.orderBy("unique_count", "position")
    return ok.select(
        "column_name",
        "position",
        F.col("unique_count").cast("long").alias("unique_count"),
        F.row_number().over(w).cast("long").alias("choice"),
    )


def first_rows(d: DataFrame, order_by: str | Sequence[str], n: int = 10) -> DataFrame:
    """The first ``n`` rows by an explicit order, as a sample.

    A bare ``limit`` has no order in Spark; ``orderBy().limit()`` plans as
    ``TakeOrderedAndProject`` (n rows per task meet in one place).
    """
    cols = _keys(order_by)
    return d.orderBy(*[F.asc_nulls_first(col_of(c)) for c in cols]).limit(n)


def group_quantiles(
    d: DataFrame,
    keys: Sequence[str] | str,
    col: str,
    probs: Sequence[float] = (0.25, 0.5, 0.75),
) -> DataFrame:
    """Quantiles of one numeric column per group (``describe`` quartiles per group)."""
    keys = _keys(keys)
    types = {f.name: f.dataType for f in d.schema.fields}
    long = d.select(*[col_of(k_) for k_ in keys], to_double(col, types[col]).alias("_v"))
    q = quantiles(long, keys, "_v", probs)
    return q.select(*keys, *[quantile_name(p) for p in probs])
