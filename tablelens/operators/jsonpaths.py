"""Structure of JSON text columns: kinds and counts by path.

Cells are parsed once into VARIANT; each level of objects and arrays is opened
by a lateral ``variant_explode`` and counted by path, so what is shuffled is one
partial count for each path, kind and task, never the values.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.functions.nulls import col_of

#: Levels of objects and arrays that are opened.
DEPTH = 6
# What a VARIANT's schema begins with, and what it is called here.
_KINDS = {
    "OBJECT": "object", "ARRAY": "array", "BIGINT": "whole", "DECIMAL": "number", "DOUBLE": "number", "FLOAT": "number",
    "STRING": "text", "BOOLEAN": "boolean", "VOID": "null",
}
_PLAIN_KEY = "^[A-Za-z0-9_]+$"


def variant_kind(v: Column) -> Column:
    """``object, array, whole, number, text, boolean`` or ``null`` of a VARIANT."""
    name = F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)
    kinds = F.create_map(*[F.lit(x) for pair in _KINDS.items() for x in pair])
    return F.coalesce(F.try_element_at(kinds, name), F.lower(name))


def _opened(level: DataFrame) -> DataFrame:
    """The members of a level's objects and arrays, one level down."""
    inside = level.sparkSession.tvf.variant_explode(F.col("v").outer())
    key = F.when(F.col("key").rlike(_PLAIN_KEY), F.col("key")).otherwise(F.concat(F.lit('"'), "key", F.lit('"')))
    step = F.when(F.col("key").isNull(), "[*]").otherwise(F.concat(F.lit("."), key))
    return level.lateralJoin(inside).select("column_name", F.concat("path", step).alias("path"), F.col("value").alias("v"))


def json_paths(d: DataFrame, cols: Sequence[str], depth: int = DEPTH) -> DataFrame:
    """``column_name, path, kind, count``: what the JSON cells of each column hold, by path.

    ``$`` is the cell, ``.key`` a member (quoted if it is no plain name),
    ``[*]`` the elements of an array. Cells that are no JSON count as kind
    ``invalid`` at ``$``; NULL cells do not count. Members below ``depth``
    levels are not looked at: their objects and arrays are counted, without
    what is in them.
    """
    cells = [F.struct(F.lit(c).alias("column_name"), col_of(c).cast("string").alias("text")) for c in cols]
    if not cells:
        return d.sparkSession.createDataFrame([], "column_name string, path string, kind string, count bigint")
    rows = d.select(F.inline(F.array(*cells))).where(F.col("text").isNotNull())
    parsed = rows.select("column_name", F.lit("$").alias("path"), F.try_parse_json("text").alias("v"))
    invalid = parsed.where(F.col("v").isNull()).select("column_name", "path", F.lit("invalid").alias("kind"))
    levels = [parsed.where(F.col("v").isNotNull())]
    for _ in range(depth):
        levels.append(_opened(levels[-1]))
    counted = [level.select("column_name", "path", variant_kind(F.col("v")).alias("kind")) for level in levels]
    every = reduce(DataFrame.unionByName, counted, invalid)
    return every.groupBy("column_name", "path", "kind").agg(F.count(F.lit(1)).alias("count"))


def json_schemas(d: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``column_name, cells, schema``: number of JSON cells of each column and the one schema that holds them all."""
    aggs = []
    for i, c in enumerate(cols):
        v = F.try_parse_json(col_of(c).cast("string"))
        aggs += [F.count(v).alias(f"_n{i}"), F.schema_of_variant_agg(v).alias(f"_s{i}")]
    if not aggs:
        return d.sparkSession.createDataFrame([], "column_name string, cells bigint, schema string")
    out = [F.struct(F.lit(c).alias("column_name"), F.col(f"_n{i}").alias("cells"), F.when(F.col(f"_n{i}") > 0, F.col(f"_s{i}")).alias("schema")) for i, c in enumerate(cols)]
    return d.agg(*aggs).select(F.inline(F.array(*out)))
