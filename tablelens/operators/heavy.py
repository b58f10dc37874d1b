"""Most frequent values without a shuffle of every distinct value.

A value is counted no more often than its hash bucket, so buckets bound what
their values can reach. One pass counts buckets, a fixed number for each
column; the second counts the values of the fullest buckets exactly; the third
those of the other buckets that hold at least as many rows as the k-th value
found so far, since no other bucket can hold a better one. Where one value
stands out, next to nothing but its bucket is counted by value; in a column
without repeats every bucket stays in and every value is counted, as it has to
be. The result is exact either way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablelens.functions.nulls import col_of

#: Buckets of a column, and how many of the fullest are counted first.
BUCKETS, FIRST = 4096, 32


def _cells(d: DataFrame, cols: Sequence[str], buckets: int) -> DataFrame:
    """``column_name, position, value, bucket`` of every non-null cell, values as text."""
    cells = [F.struct(F.lit(c).alias("column_name"), F.lit(i).alias("position"), col_of(c).cast("string").alias("value")) for i, c in enumerate(cols)]
    rows = d.select(F.inline(F.array(*cells))).where(F.col("value").isNotNull())
    return rows.withColumn("bucket", F.pmod(F.xxhash64("value"), F.lit(buckets)).cast("int"))


def _counted(cells: DataFrame, some: DataFrame) -> DataFrame:
    """Exact counts of the values in ``some`` buckets (``position, bucket``)."""
    # At most BUCKETS rows for each column are broadcast.
    own = cells.join(F.broadcast(some), ["position", "bucket"])
    return own.groupBy("column_name", "position", "value").agg(F.count(F.lit(1)).alias("count"))


def _best(counts: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("position").orderBy(F.desc("count"), F.asc("value"))
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def candidate_buckets(cells: DataFrame, k: int, first: int = FIRST) -> tuple[DataFrame, DataFrame]:
    """The buckets that are counted by value: the fullest, and the others that may hold a better value."""
    sizes = cells.groupBy("position", "bucket").agg(F.count(F.lit(1)).alias("n"))
    fullest = Window.partitionBy("position").orderBy(F.desc("n"), "bucket")
    ranked = sizes.withColumn("nth", F.row_number().over(fullest))
    head = ranked.where(F.col("nth") <= first).select("position", "bucket")
    found = _best(_counted(cells, head), k).groupBy("position").agg(F.max("rank").alias("found"), F.min("count").alias("least"))
    limit = found.select("position", F.when(F.col("found") >= k, F.col("least")).otherwise(F.lit(0)).alias("limit"))
    # One row for each column is broadcast.
    rest = ranked.where(F.col("nth") > first).join(F.broadcast(limit), "position").where(F.col("n") >= F.col("limit"))
    return head, rest.select("position", "bucket")


def heavy_values(d: DataFrame, cols: Sequence[str], k: int = 1, buckets: int = BUCKETS, first: int = FIRST) -> DataFrame:
    """``column_name, position, rank, value, count``: the ``k`` most frequent non-null values of each column.

    Values are text; equal counts go by the smaller text. A column with fewer
    than ``k`` values has them all, one without values no row.
    """
    cells = _cells(d, list(cols), buckets)
    head, rest = candidate_buckets(cells, k, first)
    best = _best(_counted(cells, head.unionByName(rest)), k)
    return best.select("column_name", "position", F.col("rank").cast("long").alias("rank"), "value", "count")
