"""The group statistics over files that keep arriving (Structured Streaming).

The reference reads one whole file per run. On a cluster the same numbers are
usually wanted for a folder that grows: re-running the batch job rescans
everything, while a streaming aggregation keeps one state row per group and
reads each new file once. The operators are the batch ones' building blocks:

* ``stream_group_sizes`` — G1 as running counts per key.
* ``stream_engagement`` — G9/G10 as running per-key totals of the metrics.
* ``stream_window_sizes`` — group sizes per event-time window with a
  watermark, so state for closed windows is dropped (append mode).

``run_available`` drains what is there now (``availableNow``) and writes the
result to Parquet beside the query's state and offsets, then returns it as a
batch DataFrame. A lost executor is made up for by the checkpoint; a driver that
is started again with the same ``folder`` resumes where the last run stopped.
"""

from __future__ import annotations

import os
from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, TimestampNTZType

from tablelens.functions.nulls import col_of
from tablelens.functions.numeric import sum_of, to_double
from tablelens.session import shared_dir


def read_stream(
    spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", max_files_per_trigger: int | None = None
) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def stream_group_sizes(stream: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Running ``keys..., size`` (complete/update output modes)."""
    return stream.groupBy(*[col_of(k) for k in keys]).agg(F.count(F.lit(1)).alias("size"))


def stream_engagement(
    stream: DataFrame, key: str, metrics: Sequence[str], exact_scale: int | None = None
) -> DataFrame:
    """Running per-key ``posts``, metric totals and ``total_engagement``.

    ``exact_scale`` keeps the totals independent of how rows fall into
    micro-batches (see ``functions.numeric.sum_of``).
    """
    types = {f.name: f.dataType for f in stream.schema.fields}
    sums = [sum_of(F.coalesce(to_double(m, types[m]), F.lit(0.0)), exact_scale).alias(m) for m in metrics]
    agg = stream.groupBy(col_of(key)).agg(F.count(F.lit(1)).alias("posts"), *sums)
    return agg.withColumn("total_engagement", reduce(add, [col_of(m) for m in metrics]))


def stream_window_sizes(
    stream: DataFrame, ts_col: str, keys: Sequence[str], window: str = "1 hour", watermark: str = "1 hour"
) -> DataFrame:
    """Group sizes per event-time window; late rows beyond the watermark are dropped.

    Watermarks need a ``TIMESTAMP`` column: a ``TIMESTAMP_NTZ`` event time is
    read as wall-clock time in the session time zone.
    """
    if isinstance(stream.schema[ts_col].dataType, TimestampNTZType):
        stream = stream.withColumn(ts_col, col_of(ts_col).cast("timestamp"))
    return (
        stream.withWatermark(ts_col, watermark)
        .groupBy(F.window(col_of(ts_col), window).alias("window"), *[col_of(k) for k in keys])
        .agg(F.count(F.lit(1)).alias("size"))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "size")
    )


def run_available(agg: DataFrame, name: str, output_mode: str = "complete", folder: str | None = None) -> DataFrame:
    """Process every file available now; return the result so far as a batch frame.

    ``folder`` keeps state, offsets and result; give the same one again to go
    on with the files that came since (by default a fresh folder is taken, so
    every call starts over). Complete mode replaces the result with each
    micro-batch; other modes write one sub-folder per micro-batch, which a
    repeated micro-batch replaces. Without any input the result is empty.
    """
    spark = agg.sparkSession
    root = folder or shared_dir(spark, f"stream-{name}")
    result_dir, state_dir = os.path.join(root, "result"), os.path.join(root, "state")
    whole = output_mode == "complete"

    def write_batch(batch: DataFrame, epoch: int) -> None:
        target = result_dir if whole else os.path.join(result_dir, f"_epoch_number={epoch}")
        batch.write.mode("overwrite").parquet(target)

    q = (
        agg.writeStream.outputMode(output_mode)
        .option("checkpointLocation", state_dir)
        .foreachBatch(write_batch)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    try:
        result = spark.read.schema(agg.schema).option("basePath", result_dir).parquet(result_dir)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], agg.schema)
    return result.select(*[col_of(c) for c in agg.columns])
