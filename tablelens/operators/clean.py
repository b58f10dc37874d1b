"""Cleaning: null tokens, trimming, coercion, dates, JSON, dedup.

All functions return lazy DataFrames. Only ``coerce_dates`` (which must know
whether every value of a column parses before it can change the column's type)
runs a job, and it collects one row per candidate column.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, FractionalType, MapType, StringType, VariantType

from tablelens.functions.json import json_normalise
from tablelens.functions.nulls import (
    FOLDED_NULL_TOKENS,
    NULL_POLICIES,
    col_of,
    null_if_token,
    strip_ws,
)
from tablelens.functions.numeric import to_double
from tablelens.session import shared_dir

_DIGEST = "__digest"

# date/time layouts tried by ``coerce_dates`` (ISO forms).
DEFAULT_DATE_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd")


def _string_columns(d: DataFrame, cols: Iterable[str] | None) -> list[str]:
    strings = [f.name for f in d.schema.fields if isinstance(f.dataType, StringType)]
    if cols is None:
        return strings
    wanted = set(cols)
    return [c for c in strings if c in wanted]


def _replace(d: DataFrame, new: dict) -> DataFrame:
    """Replace columns in place, keeping schema order and odd names."""
    return d.select(*[new[c].alias(c) if c in new else col_of(c) for c in d.columns])


def trim_cells(d: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """Strip all leading/trailing whitespace of text cells."""
    return _replace(d, {c: strip_ws(c) for c in _string_columns(d, cols)})


def normalise_nulls(
    d: DataFrame,
    tokens: Iterable[str] | str = FOLDED_NULL_TOKENS,
    trim: bool = True,
    fold_case: bool = True,
    cols: Iterable[str] | None = None,
) -> DataFrame:
    """Null tokens to NULL in text columns (S3a-c, V1).

    ``tokens`` may name a policy: ``"strict"``, ``"folded"`` or ``"empty"``.
    Default: the folded list, trimmed and compared lower-case. With ``trim``
    the surviving cells are also trimmed (the reference's python variants).
    """
    if isinstance(tokens, str):
        tokens, fold_case = NULL_POLICIES[tokens]
    tokens, strings = tuple(tokens), _string_columns(d, cols)
    # Trimmed in a projection of its own: once, however often the test for tokens names the cell.
    trimmed = trim_cells(d, strings) if trim else d
    return _replace(trimmed, {c: null_if_token(c, tokens, False, fold_case) for c in strings})


def coerce_numeric(d: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Named columns to double; unparseable cells and NaN become NULL."""
    types = {f.name: f.dataType for f in d.schema.fields}
    return _replace(d, {c: to_double(c, types[c]) for c in cols})


def date_parse_report(
    d: DataFrame, cols: Sequence[str], formats: Sequence[str] = DEFAULT_DATE_FORMATS
) -> DataFrame:
    """Per column: ``column_name, non_null, parsed, all_parse`` (one aggregate, S8)."""
    exprs = []
    for i, c in enumerate(cols):
        v = col_of(c).cast("string")
        parsed = F.coalesce(*[F.try_to_timestamp(v, F.lit(fmt)) for fmt in formats])
        exprs += [F.count(v).alias(f"_n{i}"), F.count(parsed).alias(f"_p{i}")]
    row = d.agg(*exprs)
    cells = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col(f"_n{i}").alias("non_null"),
            F.col(f"_p{i}").alias("parsed"),
        )
        for i, c in enumerate(cols)
    ]
    return row.select(F.inline(F.array(*cells))).withColumn(
        "all_parse", (F.col("non_null") > 0) & (F.col("non_null") == F.col("parsed"))
    )


def parse_timestamps(
    d: DataFrame, cols: Sequence[str], formats: Sequence[str] = DEFAULT_DATE_FORMATS
) -> DataFrame:
    """Named text columns to ``timestamp_ntz``; failures become NULL."""
    new = {}
    for c in cols:
        v = col_of(c).cast("string")
        new[c] = F.coalesce(*[F.try_to_timestamp(v, F.lit(fmt)) for fmt in formats]).cast(
            "timestamp_ntz"
        )
    return _replace(d, new)


def coerce_dates(
    d: DataFrame,
    cols: Sequence[str] | None = None,
    formats: Sequence[str] = DEFAULT_DATE_FORMATS,
) -> DataFrame:
    """Convert text columns whose every non-null value parses as a date/time."""
    cols = list(cols) if cols is not None else _string_columns(d, None)
    if not cols:
        return d
    report = date_parse_report(d, cols, formats).where("all_parse").select("column_name").collect()
    return parse_timestamps(d, [r["column_name"] for r in report], formats)


def normalise_json(d: DataFrame, cols: Sequence[str]) -> DataFrame:
    """JSON text columns: empty, ``{}`` and ``[]`` to NULL, the rest unchanged."""
    present = [c for c in cols if c in d.columns]
    return _replace(d, {c: json_normalise(c) for c in present})


def dedup(d: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Exact-row dedup, NULL equal to NULL (U1). Map-side partial aggregation
    collapses a hot duplicate before the shuffle."""
    return d.dropDuplicates(list(subset)) if subset else d.dropDuplicates()


def row_digest(d: DataFrame, cols: Sequence[str], bits: int = 128) -> Column:
    """A digest of the cells of ``cols``: equal for rows that group together (NULL equal to NULL, -0.0 to 0.0).

    Two seeded 64-bit hashes over the cells and over which of them are NULL
    (a hash passes NULLs over); the first ``bits`` bits of the two count.
    """
    kinds = {f.name: f.dataType for f in d.schema.fields}
    cells = [col_of(c) + F.lit(0.0).cast(kinds[c]) if isinstance(kinds[c], FractionalType) and not isinstance(kinds[c], DecimalType) else col_of(c) for c in cols]
    nulls = [col_of(c).isNull() for c in cols]
    halves = [F.xxhash64(F.lit(seed), *nulls, *cells) for seed in (1, 2)]
    kept = [F.shiftrightunsigned(h, 64 - b) for h, b in zip(halves, (min(bits, 64), bits - 64), strict=True) if b > 0]
    return F.struct(*[k.alias(f"d{i}") for i, k in enumerate(kept)])


def repeated_digests(d: DataFrame, cols: Sequence[str], bits: int = 128) -> DataFrame:
    """``digest`` of rows that share theirs with another row; shuffles digests and counts, no cells."""
    counts = d.groupBy(row_digest(d, cols, bits).alias("digest")).agg(F.count(F.lit(1)).alias("n"))
    return counts.where("n > 1").select("digest")


#: Repeated digests up to which they are broadcast (16 bytes each).
DIGESTS = 1_000_000


def dedup_by_digest(d: DataFrame, bits: int = 128, broadcast_rows: int = DIGESTS) -> DataFrame:
    """``dedup`` for wide rows: 128-bit row digests meet first.

    Digests and counts are grouped and the repeated ones written to the shared
    folder. Rows with a digest of their own are distinct as they are and stay
    where they were read; only rows that share a digest are shuffled and
    compared cell by cell, so a collision merges nothing. With more than
    ``broadcast_rows`` repeated digests all rows are compared (``dedup``).
    """
    if not d.columns or any(isinstance(f.dataType, (MapType, VariantType)) for f in d.schema.fields):
        return dedup(d)
    target = shared_dir(d.sparkSession, "digests")
    repeated = repeated_digests(d, d.columns, bits)
    repeated.write.parquet(target)
    repeated = d.sparkSession.read.schema(repeated.schema).parquet(target)
    if repeated.count() > broadcast_rows:
        return dedup(d)
    keyed = d.withColumn(_DIGEST, row_digest(d, d.columns, bits))
    side = F.broadcast(repeated.withColumnRenamed("digest", _DIGEST))
    alone = keyed.join(side, _DIGEST, "left_anti").drop(_DIGEST)
    shared = keyed.join(side, _DIGEST, "left_semi").drop(_DIGEST)
    return alone.unionAll(shared.dropDuplicates())


def dedup_counts_by_digest(d: DataFrame, bits: int = 128) -> DataFrame:
    """``dedup_counts`` over all columns that compares only rows whose digest repeats."""
    digest = row_digest(d, d.columns, bits).alias(_DIGEST)
    counts = d.groupBy(digest).agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("rows_before"), F.count_if(F.col("n") == 1).alias("alone")
    )
    repeated = repeated_digests(d, d.columns, bits).withColumnRenamed("digest", _DIGEST)
    keyed = d.select("*", digest)
    shared = keyed.join(repeated.hint("rebalance"), _DIGEST, "left_semi").groupBy(*[col_of(c) for c in d.columns]).agg(F.lit(1))
    distinct = shared.agg(F.count(F.lit(1)).alias("n")).scalar()
    after = (F.col("alone") + distinct).alias("rows_after")
    return counts.select("rows_before", after).withColumn("duplicates_removed", F.col("rows_before") - F.col("rows_after"))


def dedup_counts(d: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """One row: ``rows_before, rows_after, duplicates_removed`` in one pass."""
    keys = [col_of(c) for c in (subset or d.columns)]
    per_row = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return per_row.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("rows_before"),
        F.count(F.lit(1)).alias("rows_after"),
    ).withColumn("duplicates_removed", F.col("rows_before") - F.col("rows_after"))


def dedup_normalised(d: DataFrame) -> DataFrame:
    """Dedup on the text of all cells with NULL and '' alike.

    Returns the normalised text rows; the reference's joined-string key could
    merge rows whose cells contain the separator, which is not reproduced.
    """
    return d.select(
        *[F.coalesce(col_of(c).cast("string"), F.lit("")).alias(c) for c in d.columns]
    ).dropDuplicates()


def distinct_keys(d: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct key combinations (U4)."""
    return d.select(*[col_of(k) for k in keys]).distinct()
