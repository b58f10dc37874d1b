"""Records of delimited text whose quoted cells hold line breaks, read by split.

A file is read line by line in splits, as many tasks as it has splits. Whether
a line begins inside a quoted cell depends on all lines before it; but a line
maps the two states it may begin in (outside, inside) to the states it ends in,
and such maps compose. A line's map is the identity (no quotes), constant, or
the swap, so the state after any line of a split is the value of the last
constant line, turned round by the swaps since. Windows over the lines that
hold quotes give each split's map, a window over splits (one row each) the state
in which a split begins, and only splits in which some line ends inside a cell
send their lines through a shuffle to be joined into records. The rest of the
files is parsed where it is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUOTE = '"'


def _whole_cells(sep: str) -> str:
    """Lines of whole cells, quoted from end to end or without quotes: such lines end outside (the test of one is short).

    Possessive throughout: no way back is tried and the depth does not grow with the line.
    """
    by = sep if sep.isalnum() else "\\" + sep
    # Cells without quotes go in one piece, up to a quote that begins a cell.
    return f'^[^"]*+(?:(?:(?<={by})|^)"[^"]*+(?:""[^"]*+)*+"(?:{by}[^"]*+|\\r?\\z))*+\\z'


def _has_pattern(sep: str) -> bool:
    return len(sep) == 1 and sep != QUOTE


def _ends_inside(line: Column, sep: str, inside: bool) -> Column:
    """Whether a line ends inside a quoted cell, if it begins outside or ``inside`` one.

    A quote opens a cell only where the cell begins; inside, two quotes are one
    of the cell's, a single one closes it, and what follows up to the separator
    belongs to the cell as it is.
    """
    out, in_cell, closed = F.lit(0), F.lit(1), F.lit(2)

    def at_quote(state: Column, before: Column) -> Column:
        """State after a quote; ``before`` is the text since the last one (a separator stands in for the line's begin)."""
        opens = F.endswith(before, F.lit(sep))
        return (
            F.when(state == in_cell, closed)
            .when((state == closed) & (before == ""), in_cell)
            .when(opens, in_cell)
            .otherwise(out)
        )

    pieces = F.split(F.concat(F.lit(sep), line), QUOTE)
    last = F.aggregate(F.slice(pieces, 1, F.size(pieces) - 1), in_cell if inside else out, at_quote)
    ends = last == in_cell
    if not inside and _has_pattern(sep):
        ends = F.when(line.rlike(_whole_cells(sep)), F.lit(False)).otherwise(ends)
    return F.when(F.contains(line, F.lit(QUOTE)), ends).otherwise(F.lit(inside))


def _lines(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """``value, path, split, line`` and the line's map: ``o`` and ``i``, whether it ends inside from outside and inside."""
    raw = spark.read.option("lineSep", "\n").text(path)
    placed = raw.select(
        "value",
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("line"),
    )
    return placed.withColumns({"o": _ends_inside(F.col("value"), sep, False), "i": _ends_inside(F.col("value"), sep, True)})


def _running(keys: list[str], order: str) -> tuple[Column, Column]:
    """``(base, swaps)`` up to each row: value and swap count of the last constant map (null: none), and all swaps."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swaps = F.sum((F.col("o") & ~F.col("i")).cast("int")).over(w)
    constant = F.when(F.col("o") == F.col("i"), F.struct(F.col("i").alias("value"), F.col("swaps")))
    return F.last(constant, ignorenulls=True).over(w), swaps


def _states(d: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``d`` with the composed map of all rows of a key up to each: ``after_o`` and ``after_i``."""
    base, swaps = _running(keys, order)
    odd = (F.col("swaps") - F.coalesce(F.col("base.swaps"), F.lit(0))) % 2 == 1
    return (
        d.withColumn("swaps", swaps)
        .withColumn("base", base)
        .withColumn("after_o", F.coalesce("base.value", F.lit(False)) != odd)
        .withColumn("after_i", F.coalesce("base.value", F.lit(True)) != odd)
        .drop("swaps", "base")
    )


def _splits(lines: DataFrame) -> DataFrame:
    """``path, split, first, begins_inside, broken``: one row per split.

    ``first`` is its first line; ``broken``: some line of it begins or ends
    inside a cell.
    """
    every = lines.groupBy("path", "split").agg(F.min("line").alias("first"))
    quoted = lines.where("o OR NOT i").select("path", "split", "line", "o", "i")
    composed = (
        _states(quoted, ["path", "split"], "line")
        .groupBy("path", "split")
        .agg(
            F.max_by("after_o", "line").alias("o"),
            F.max_by("after_i", "line").alias("i"),
            F.bool_or("after_o").alias("any_o"),
        )
    )
    maps = every.join(composed, ["path", "split"], "left").select(
        "path", "split", "first", F.coalesce("any_o", F.lit(False)).alias("any_o"),
        F.coalesce("o", F.lit(False)).alias("o"), F.coalesce("i", F.lit(True)).alias("i"),
    )
    before = F.lag("after_o", 1, False).over(Window.partitionBy("path").orderBy("split"))
    return (
        _states(maps, ["path"], "split")
        .withColumn("begins_inside", before)
        .select("path", "split", "first", "begins_inside", (F.col("begins_inside") | F.col("any_o")).alias("broken"))
    )


def has_line_breaks(spark: SparkSession, path: str, sep: str = ",") -> bool:
    """Whether some line of the files ends inside a quoted cell (a scan that stops at the first one).

    A scan for lines that are not whole cells goes first: the walk along their
    quotes has no generated code, and a filter that holds it runs without.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    if _has_pattern(sep) and lines.where(F.contains("value", F.lit(QUOTE)) & ~F.col("value").rlike(_whole_cells(sep))).isEmpty():
        return False
    return not lines.where(_ends_inside(F.col("value"), sep, False)).isEmpty()


def records(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """``record, path, split, line, head``: every record of the files, line breaks inside quoted cells kept.

    ``path, split, line`` order the records of the files; ``head`` marks the
    first line of each file. Records end at line feeds (a carriage return
    before one is left out); blank lines outside cells are no records. A cell
    that a file leaves open ends with the file.
    """
    lines = _lines(spark, path, sep)
    splits = _splits(lines)
    placed = lines.join(splits, ["path", "split"])
    head = (F.col("split") == 0) & (F.col("line") == F.col("first"))
    whole = placed.where("NOT broken").select(F.col("value").alias("record"), "path", "split", "line", head.alias("head"))
    # Lines of broken splits: state at their begin, and the line with which their record begins.
    own = Window.partitionBy("path", "split").orderBy("line")
    begins = F.coalesce(
        F.lag(F.when(F.col("begins_inside"), F.col("after_i")).otherwise(F.col("after_o"))).over(own), F.col("begins_inside")
    )
    upto = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    torn = (
        _states(placed.where("broken"), ["path", "split"], "line")
        .withColumn("inside", begins)
        .withColumn("opened", F.last(F.when(~F.col("inside"), F.col("line")), ignorenulls=True).over(upto))
    )
    # A record that an earlier split opened: the last one that a split before this one opened.
    opened = torn.groupBy("path", "split").agg(F.max("opened").alias("last"))
    earlier = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    held = opened.select(
        "path", "split", F.last(F.when(F.col("last").isNotNull(), F.struct("split", "last")), ignorenulls=True).over(earlier).alias("from")
    )
    keyed = torn.join(held, ["path", "split"]).select(
        "path",
        F.when(F.col("opened").isNull(), F.col("from.split")).otherwise(F.col("split")).alias("in_split"),
        F.coalesce("opened", "from.last").alias("at_line"),
        head.alias("head"), "split", "line", "value",
    )
    # What only the lines of one record have in common: never more than that record.
    joined = keyed.groupBy("path", "in_split", "at_line").agg(
        F.array_sort(F.collect_list(F.struct("split", "line", "value"))).alias("parts"), F.bool_or("head").alias("head")
    )
    mended = joined.select(
        F.array_join(F.transform("parts", lambda p: p["value"]), "\n").alias("record"),
        "path", F.col("in_split").alias("split"), F.col("at_line").alias("line"), "head",
    )
    every = whole.unionByName(mended).withColumn("record", F.regexp_replace("record", "\r$", ""))
    return every.where(F.trim("record") != "")
