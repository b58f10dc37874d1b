"""Global ranks and exact quantiles without funnelling data into one task.

``Window.orderBy(...)`` with no partition moves every row to one task, and the
exact ``percentile`` aggregate keeps a value->count map of a whole group in one
task. Both are fine for ten rows and fatal for billions. The two helpers here
give the same answers at any size, by one method each:

* ``global_rank``: range-partition on the order, sort each partition, and write
  it with partition number and row position to the shared folder. Row counts
  per partition and ranks are both read from those files, so they fit whatever
  columns a caller keeps.
* ``quantiles``: one scan brackets every wanted rank of every group with
  ``percentile_approx``; a second scan counts the rows below each bracket
  (map-side) and shuffles only the values inside it, which are sorted to find
  the values at the interpolation ranks. Linear interpolation at ``(n - 1) * p``
  is the rule of ``percentile``, numpy and DuckDB's ``quantile_cont``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablelens.session import shared_dir

_LOW_BITS = 33
_LOW_MASK = (1 << _LOW_BITS) - 1


def global_rank(df: DataFrame, order: Sequence[Column], rank_col: str = "rank") -> DataFrame:
    """Add ``rank_col`` = 1..n following ``order`` (which should be a total order).

    The ordered rows are written once, when this is called: two reads of a
    range partitioning that is only planned may sample different bounds.
    """
    order = list(order)
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    tagged = (
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("_rid", F.monotonically_increasing_id())
        .select(
            "*",
            F.shiftright("_rid", _LOW_BITS).alias("_part"),
            F.col("_rid").bitwiseAND(F.lit(_LOW_MASK)).alias("_local"),
        )
        .drop("_rid")
    )
    target = shared_dir(spark, "rank")
    tagged.write.parquet(target)
    rows = spark.read.schema(tagged.schema).parquet(target)
    # One row per partition: bounded by the partition count, safe to broadcast.
    offsets = (
        rows.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            "_part",
            F.coalesce(
                F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0),
            ).alias("_offset"),
        )
    )
    return (
        rows.join(F.broadcast(offsets), "_part")
        .withColumn(rank_col, F.col("_offset") + F.col("_local") + F.lit(1))
        .drop("_part", "_local", "_offset")
    )


def quantile_name(p: float) -> str:
    """Column name of a probability: 0.25 -> ``q25``, 0.5 -> ``q50``, 0.975 -> ``q97_5``."""
    text = f"{p * 100:.6f}".rstrip("0").rstrip(".")
    return "q" + text.replace(".", "_")


# Entries of the sketch that brackets a rank: its rank error is n / ACCURACY.
ACCURACY = 10_000
_ALL = -1  # bracket number of a group whose values are all kept


def quantiles(
    long_df: DataFrame,
    group_cols: Sequence[str],
    value_col: str,
    probs: Sequence[float],
    accuracy: int = ACCURACY,
    few_groups: bool = False,
) -> DataFrame:
    """Exact linearly interpolated quantiles of ``value_col`` per group.

    Returns ``group_cols`` + one ``q<p>`` double column per probability; groups
    without a non-null value are absent (callers left-join to keep them).
    Infinite values are ordered like any other.

    The sketch's rank error is at most ``n / accuracy``, so the values at
    probabilities two errors below and above ``p`` enclose the wanted ranks
    of a group of more than ``4 * accuracy`` values; a smaller group's bracket
    is everything. At most about ``6 / accuracy`` of a large group's rows are
    shuffled per probability, as distinct values with counts, and sorted
    (spillably) in one task each. With ``few_groups`` (the caller knows the
    groups are, e.g., column names) the brackets are broadcast; otherwise
    their join is left to Spark, which broadcasts them only below its measured
    size threshold.
    """
    group_cols, probs = list(group_cols), [float(p) for p in probs]
    groups = [F.col(g) for g in group_cols]
    values = long_df.where(F.col(value_col).isNotNull()).select(*groups, F.col(value_col).cast("double").alias("_v"))
    margin = 2.0 / accuracy
    ends = [e for p in probs for e in (max(0.0, p - margin), min(1.0, p + margin))]
    brackets = values.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("_total"), F.percentile_approx("_v", ends, accuracy).alias("_ends")
    )
    brackets = brackets.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group_cols)], "_total", "_ends")
    same = F.lit(True)
    for i, g in enumerate(group_cols):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    # Rebalanced brackets make the join a plain shuffle on both sides, whose hot groups AQE may split.
    joined = values.join(F.broadcast(brackets) if few_groups else brackets.hint("rebalance"), same)
    small = F.col("_total") <= 4 * accuracy
    number, value = F.lit(None).cast("int"), F.lit(None).cast("double")
    cells = []
    for i in range(len(probs)):
        low, high = F.col("_ends")[2 * i], F.col("_ends")[2 * i + 1]
        whole = F.lit(_ALL) if i == 0 else number
        cells.append(
            F.struct(
                F.when(small, whole).when(F.col("_v") <= high, F.lit(i)).otherwise(number).alias("_q"),
                F.when(small | (F.col("_v") >= low), F.col("_v")).otherwise(value).alias("_in"),
            )
        )
    marked = joined.select(*groups, "_total", F.inline(F.array(*cells))).where("_q IS NOT NULL")
    # Rows below a bracket have no value: one row per group and bracket in each task.
    counted = marked.groupBy(*groups, "_q", F.col("_in").alias("_v")).agg(
        F.count(F.lit(1)).alias("_n"), F.max("_total").alias("_total")
    )
    order = Window.partitionBy(*group_cols, "_q").orderBy(F.asc_nulls_first("_v"))
    upto = F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = counted.withColumn("_upto", upto).where("_v IS NOT NULL")
    return _pick_ranks(ranked, group_cols, probs)


def _pick_ranks(ranked: DataFrame, group_cols: list[str], probs: list[float]) -> DataFrame:
    """From ``(groups, _q, _v, _n, _total, _upto)`` (``_v`` holds the ranks from
    ``_upto - _n`` to before ``_upto`` of ``_total``), interpolate each quantile.

    The target ranks floor/ceil((n - 1) * p) are column expressions, so one
    conditional aggregate per group picks the values at them.
    """
    aggs = []
    for i, p in enumerate(probs):
        h = (F.col("_total") - 1) * F.lit(p)

        def at(rank: Column, number: int = i) -> Column:
            here = F.col("_q").isin(number, _ALL) & (rank >= F.col("_upto") - F.col("_n")) & (rank < F.col("_upto"))
            return F.max(F.when(here, F.col("_v")))

        aggs += [at(F.floor(h)).alias(f"_lo{i}"), at(F.ceil(h)).alias(f"_hi{i}"), F.max(h - F.floor(h)).alias(f"_fr{i}")]
    picked = ranked.groupBy(*[F.col(g) for g in group_cols]).agg(*aggs)

    def between(i: int) -> Column:
        lo, hi, fr = F.col(f"_lo{i}"), F.col(f"_hi{i}"), F.col(f"_fr{i}")
        endless = F.abs(lo).isin(float("inf")) | F.abs(hi).isin(float("inf"))
        return F.when(lo == hi, lo).when(fr == 0, lo).when(endless, lo * (1 - fr) + hi * fr).otherwise(lo + fr * (hi - lo))

    return picked.select(*group_cols, *[between(i).alias(quantile_name(p)) for i, p in enumerate(probs)])


def approx_quantiles(
    long_df: DataFrame,
    group_cols: Sequence[str],
    value_col: str,
    probs: Sequence[float],
    accuracy: int = 10000,
) -> DataFrame:
    """Bounded-memory quantiles (``percentile_approx``), same output shape."""
    arr = F.percentile_approx(F.col(value_col), list(probs), accuracy)
    out = long_df.groupBy(*group_cols).agg(arr.alias("_qs"))
    return out.select(
        *group_cols,
        *[F.col("_qs")[i].cast("double").alias(quantile_name(p)) for i, p in enumerate(probs)],
    )
