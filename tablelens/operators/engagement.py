"""Engagement totals, rankings and category shares.

Metrics may be text (coerced with the numeric grammar) or numeric; a missing
metric value counts as 0 in totals (P3). All sums are computed by one
``groupBy`` per call; rankings over several metrics are taken from that single
aggregate (the reference rebuilt the table once per metric).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablelens.functions.nulls import col_of
from tablelens.functions.numeric import mean_of, sum_of, to_double
from tablelens.operators.groups import key_order, rank_rows, require_columns
from tablelens.operators.ordering import global_rank

TOTAL = "total_engagement"


def available_metrics(d: DataFrame, metrics: Sequence[str]) -> list[str]:
    """The metrics that exist in the table, in the given order (P5)."""
    return [m for m in metrics if m in d.columns]


def _metric(d: DataFrame, m: str) -> Column:
    types = {f.name: f.dataType for f in d.schema.fields}
    return to_double(m, types[m])


def row_total(d: DataFrame, metrics: Sequence[str], name: str = TOTAL) -> DataFrame:
    """Add the row-wise sum of the metrics, a missing value counting as 0."""
    metrics = available_metrics(d, metrics)
    if not metrics:
        raise ValueError("none of the metrics is in the table")
    total = reduce(add, [F.coalesce(_metric(d, m), F.lit(0.0)) for m in metrics])
    return d.withColumn(name, total)


def engagement_by_group(
    d: DataFrame,
    key: str,
    metrics: Sequence[str],
    k: int = 10,
    rank_by: str = "total",
    drop_null_keys: bool = False,
    exact_scale: int | None = None,
) -> DataFrame:
    """Per group: posts, total and mean engagement; the k best groups.

    ``rank_by="total"`` orders by total engagement (pandas/polars form),
    ``"posts"`` by number of rows. Output: ``rank, key, posts,
    total_engagement, avg_engagement``.
    """
    require_columns(d, [key])
    base = row_total(d, metrics)
    if drop_null_keys:
        base = base.where(col_of(key).isNotNull())
    per_group = base.groupBy(col_of(key)).agg(
        F.count(F.lit(1)).alias("posts"),
        sum_of(F.col(TOTAL), exact_scale).alias(TOTAL),
        mean_of(F.col(TOTAL), exact_scale).alias("avg_engagement"),
    )
    measure = {"total": TOTAL, "posts": "posts"}[rank_by]
    order = [F.desc(measure), *key_order([key])]
    top = per_group.orderBy(*order).limit(k)
    return rank_rows(top, order).select("rank", key, "posts", TOTAL, "avg_engagement")


def group_metric_totals(
    d: DataFrame,
    key: str,
    metrics: Sequence[str],
    total_name: str = TOTAL,
    exact_scale: int | None = None,
) -> DataFrame:
    """Per key: each metric's total (no values -> 0) and their sum."""
    require_columns(d, [key])
    metrics = available_metrics(d, metrics)
    # Converted below the aggregate: each cell once.
    values = d.select(col_of(key), *[_metric(d, m).alias(f"_v{i}") for i, m in enumerate(metrics)])
    sums = [F.coalesce(sum_of(F.col(f"_v{i}"), exact_scale), F.lit(0.0)).alias(m) for i, m in enumerate(metrics)]
    out = values.groupBy(col_of(key)).agg(*sums)
    return out.withColumn(total_name, reduce(add, [col_of(m) for m in metrics]))


def page_engagement(
    d: DataFrame, key: str, metrics: Sequence[str], k: int = 10, exact_scale: int | None = None
) -> DataFrame:
    """The k keys with the largest total engagement (W6): ``rank, key, metrics..., total``."""
    metrics = available_metrics(d, metrics)
    totals = group_metric_totals(d, key, metrics, exact_scale=exact_scale)
    order = [F.desc(TOTAL), *key_order([key])]
    top = totals.orderBy(*order).limit(k)
    return rank_rows(top, order).select("rank", key, *metrics, TOTAL)


def category_rankings(
    d: DataFrame,
    key: str,
    metrics: Sequence[str],
    k: int = 5,
    max_metrics: int | None = None,
    exact_scale: int | None = None,
) -> DataFrame:
    """Top k categories by each metric's total.

    All metrics, or the first ``max_metrics`` of them if given (P7).

    One aggregate for all metrics, then ``row_number() <= k`` per metric,
    which Spark limits per map task (``WindowGroupLimit``) before the shuffle.
    Output: ``metric, rank, key, total``.
    """
    metrics = available_metrics(d, metrics)[:max_metrics]
    totals = group_metric_totals(d, key, metrics, exact_scale=exact_scale).drop(TOTAL)
    cells = F.inline(
        F.array(*[F.struct(F.lit(m).alias("metric"), col_of(m).alias("total")) for m in metrics])
    )
    long = totals.select(col_of(key), cells)
    w = Window.partitionBy("metric").orderBy(F.desc("total"), *key_order([key]))
    return (
        long.withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k)
        .select("metric", F.col("rank").cast("long").alias("rank"), key, "total")
    )


def category_share(d: DataFrame, key: str, decimals: int = 1) -> DataFrame:
    """Every category with its row count, share of all rows and rank.

    The NULL category is listed; the denominator is all rows, taken as the
    sum of the category counts in a scalar subquery (it reads the aggregated
    frame, whose exchange Spark shares with the main query, not the source
    again; no join). Ranks come from ``global_rank`` (range partitioned), so
    a column with millions of categories never meets in one task.
    """
    require_columns(d, [key])
    counts = d.groupBy(col_of(key)).agg(F.count(F.lit(1)).alias("count"))
    total = counts.select(F.sum("count")).scalar()
    ranked = global_rank(counts, [F.desc("count"), *key_order([key])])
    return ranked.select(
        "rank",
        key,
        "count",
        F.round(F.try_divide(F.lit(100.0) * F.col("count"), total), decimals).alias(
            "pct"
        ),
    )


def category_means(
    d: DataFrame, key: str, cols: Sequence[str], max_cols: int | None = None, exact_scale: int | None = None
) -> DataFrame:
    """Per category: mean and count of numeric columns, the first ``max_cols`` if given."""
    require_columns(d, [key])
    cols = list(cols)[:max_cols]
    aggs = []
    for c in cols:
        v = _metric(d, c)
        aggs += [mean_of(v, exact_scale).alias(f"{c}_mean"), F.count(v).alias(f"{c}_count")]
    return d.groupBy(col_of(key)).agg(F.count(F.lit(1)).alias("row_count"), *aggs)
