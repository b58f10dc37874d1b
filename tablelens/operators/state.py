"""Profiles of growing folders: mergeable state per input file, united on demand.

A state table holds, for each input file and column, what merges without the
rows: counts, extremes, exact sums of whole units and of their squares, a
HyperLogLog sketch of the distinct values and a KLL sketch of the quantiles;
and for each file and key its group sizes. ``update`` reads the files that the
table does not have yet, those alone, and appends their rows; a profile is an
aggregate over the state table, however large the files are.

Everything but the sketches is exact and equal to one run over all files. The
sketches' errors are stated: distinct counts within ``DISTINCT_ERROR`` (three
standard errors), quantile ranks within ``RANK_ERROR`` of the rows.

Each update writes one version: a folder of its own, and then a marker file that
names it. Readers look at marked versions only, so an update that fails half-way
leaves nothing behind that counts, and its files are read again.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Sequence
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from tablelens.functions.nulls import col_of
from tablelens.functions.numeric import exact_spread, exact_units, to_double

#: Sketch sizes: 2^LG_K registers, and the KLL's k.
LG_K, KLL_K = 14, 800
#: Three standard errors of a distinct count, and a quantile's rank error (99 % bound for one quantile).
DISTINCT_ERROR, RANK_ERROR = 3 * 0.83 / 2**7, 0.006
_FILE = "__file"
_STATE = (
    "file string, column_name string, position int, rows bigint, present bigint, numeric bigint, low double, high double, "
    "unfit bigint, units decimal(38,0), squares decimal(38,0), total double, distinct binary, quantiles binary"
)


class ProfileState:
    """State of a folder's profile at ``path``.

    ``numeric`` columns have moments and quantiles, ``text`` columns counts and
    distinct values, ``keys`` (a tuple of columns each) group sizes. ``scale``
    is the number of decimals that sums keep exactly.
    """

    def __init__(self, spark: SparkSession, path: str, numeric: Sequence[str], text: Sequence[str] = (), keys: Sequence[Sequence[str]] = (), scale: int = 2):
        self.spark, self.path, self.scale = spark, path, scale
        self.numeric, self.text, self.keys = list(numeric), list(text), [list(k) for k in keys]

    # ------------------------------------------------------------- versions

    def _versions(self, part: str) -> list[str]:
        """Folders of the marked versions."""
        try:
            marks = self.spark.read.schema("version string").json(os.path.join(self.path, "versions"))
            names = [r["version"] for r in marks.distinct().collect()]
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in (missing.getCondition() or ""):
                raise
            names = []
        return [os.path.join(self.path, n, part) for n in sorted(names)]

    def files(self) -> set[str]:
        """Input files that the state holds (one name each comes to the driver, as in a file listing)."""
        return {r["file"] for r in self._columns().select("file").distinct().collect()}

    def _columns(self) -> DataFrame:
        folders = self._versions("columns")
        return self.spark.read.schema(_STATE).parquet(*folders) if folders else self.spark.createDataFrame([], _STATE)

    def update(self, path: str, read: Callable[[list[str]], DataFrame] | None = None) -> list[str]:
        """Take in the files under ``path`` that are new; their names.

        ``read`` makes a scan of paths (Parquet by default): of ``path`` to
        list its files, then of the new ones alone. A file counts as known by
        its name: files are added, never changed.
        """
        read = read or (lambda paths: self.spark.read.parquet(*paths))
        source = read([path])
        new = sorted(set(source.inputFiles()) - self.files())
        if not new:
            return []
        version = f"v-{uuid.uuid4().hex[:12]}"
        rows = read([unquote(f) for f in new]).withColumn(_FILE, F.input_file_name())
        kinds = {f.name: f.dataType for f in source.schema.fields}
        self._column_state(rows, kinds).write.parquet(os.path.join(self.path, version, "columns"))
        for i, keys in enumerate(self.keys):
            sizes = rows.groupBy(F.col(_FILE).alias("file"), *[col_of(k) for k in keys]).agg(F.count(F.lit(1)).alias("size"))
            sizes.write.parquet(os.path.join(self.path, version, f"groups-{i}"))
        mark = self.spark.createDataFrame([(version,)], "version string")
        mark.coalesce(1).write.mode("append").json(os.path.join(self.path, "versions"))
        return new

    def _column_state(self, rows: DataFrame, kinds: dict[str, DataType]) -> DataFrame:
        """One row per new file and column: one scan, one small shuffle."""
        aggs = [F.count(F.lit(1)).alias("_rows")]
        cells = []
        for i, c in enumerate([*self.numeric, *self.text]):
            own = col_of(c)
            aggs += [F.count(own).alias(f"_n{i}"), F.hll_sketch_agg(own.cast("string"), LG_K).alias(f"_d{i}")]
            if c in self.numeric:
                v = to_double(c, kinds[c])
                unit, unfit = exact_units(v, self.scale)
                aggs += [
                    F.count(v).alias(f"_v{i}"), F.min(v).alias(f"_lo{i}"), F.max(v).alias(f"_hi{i}"),
                    F.count_if(unfit).alias(f"_u{i}"), F.sum(unit).cast("decimal(38,0)").alias(f"_s{i}"),
                    F.try_sum(unit * unit).alias(f"_q{i}"), F.sum(v).alias(f"_t{i}"),
                    F.kll_sketch_agg_double(v, KLL_K).alias(f"_k{i}"),
                ]
            numbers = [f"_v{i}", f"_lo{i}", f"_hi{i}", f"_u{i}", f"_s{i}", f"_q{i}", f"_t{i}", f"_d{i}", f"_k{i}"]
            names = ["numeric", "low", "high", "unfit", "units", "squares", "total", "distinct", "quantiles"]
            types = ["bigint", "double", "double", "bigint", "decimal(38,0)", "decimal(38,0)", "double", "binary", "binary"]
            made = [
                (F.col(a) if c in self.numeric or b == "distinct" else F.lit(None)).cast(t).alias(b)
                for a, b, t in zip(numbers, names, types, strict=True)
            ]
            cells.append(F.struct(F.lit(c).alias("column_name"), F.lit(i).alias("position"), F.col("_rows").alias("rows"), F.col(f"_n{i}").alias("present"), *made))
        return rows.groupBy(F.col(_FILE).alias("file")).agg(*aggs).select("file", F.inline(F.array(*cells)))

    # ------------------------------------------------------------- profiles

    def profile(self, ddof: int = 1, probs: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
        """Per column: ``column_name, position, count, missing, mean, std, min, max, distinct_count`` and quantiles ``q25``...

        Numeric statistics are NULL for text columns. Counts, extremes, mean
        and deviation are exact (mean and deviation where every value has at
        most ``scale`` decimals, see ``std_of``); distinct counts and quantiles
        are the sketches'.
        """
        numeric = F.col("position") < len(self.numeric)
        n = F.sum("numeric")
        units, unfit = F.sum("units").cast("decimal(38,0)"), F.coalesce(F.sum("unfit"), F.lit(0))
        # A version whose squares outgrew 38 digits has none, and neither has the whole.
        squares = F.when(F.count_if((F.col("numeric") > 0) & F.col("squares").isNull()) == 0, F.try_sum("squares"))
        merged = self._columns().groupBy("column_name", "position").agg(
            F.sum("present").alias("present"), F.sum("rows").alias("rows"), n.alias("n"),
            F.min("low").alias("min"), F.max("high").alias("max"), unfit.alias("unfit"),
            units.alias("units"), squares.cast("decimal(38,0)").alias("squares"), F.sum("total").alias("total"),
            F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("distinct_count"),
            F.kll_merge_agg_double("quantiles", KLL_K).alias("kll"),
        )
        unit = F.lit(float(10**self.scale))
        mean = F.when(F.col("unfit") == 0, F.try_divide(F.col("units").cast("double") / unit, F.col("n").cast("double")))
        spread = exact_spread(F.col("n"), F.col("units"), F.col("squares"))
        std = F.when((F.col("unfit") == 0) & (F.col("n") > ddof), F.sqrt(spread / (F.col("n") - F.lit(float(ddof)))) / unit)
        some = F.coalesce(F.col("n"), F.lit(0)) > 0
        quantiles = [F.when(some, F.kll_sketch_get_quantile_double("kll", F.lit(float(p)))).alias(f"q{round(p * 100):02d}") for p in probs]
        count = F.when(numeric, F.col("n")).otherwise(F.col("present"))
        return merged.select(
            "column_name", "position", count.alias("count"), (F.col("rows") - count).alias("missing"),
            F.coalesce(mean, F.try_divide("total", F.col("n").cast("double"))).alias("mean"), std.alias("std"), "min", "max", "distinct_count", *quantiles,
        )

    def group_sizes(self, which: int = 0) -> DataFrame:
        """Sizes of all groups of the key set number ``which``: ``keys..., size``."""
        folders = self._versions(f"groups-{which}")
        if not folders:
            raise ValueError("no update yet: the keys' types are not known")
        parts = self.spark.read.parquet(*folders)
        return parts.groupBy(*[col_of(k) for k in self.keys[which]]).agg(F.sum("size").alias("size"))


def rank_of(value: Column, at: Column) -> tuple[Column, Column]:
    """Shares of the values below, and not above, ``at``: the ranks that a quantile may have."""
    n = F.count(value).cast("double")
    return F.count_if(value < at) / n, F.count_if(value <= at) / n
