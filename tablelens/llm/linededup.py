"""Line dedup over overlapping three-line windows (DataFrame functions only).

Three consecutive lines are hashed together, so a short line that many texts
share is no repetition by itself, while a passage that recurs is. The first
occurrence of every window is found by a grouped minimum (combined before the
shuffle, so a window that a third of all texts share is no hot spot); every
later occurrence covers its lines, covered ranges are merged, and what lies
between them is what stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.llm.common import pick, position, restore, with_keys

WINDOW = 3
#: ASCII white space that a line is compared without, at both ends.
_BLANK = " \t\r\v\f"


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _windows(docs: DataFrame, size: int) -> DataFrame:
    """``(doc_id, doc_key, h1, h2, first, last)``: windows over non-blank lines.

    ``first`` and ``last`` are 0-based line numbers in the text; a 128-bit hash
    stands for the trimmed lines.
    """
    lines = F.transform(F.split(_text("text"), "\n"), lambda x, i: F.struct(F.btrim(x, F.lit(_BLANK)).alias("line"), i.alias("at")))
    filled = docs.select(
        "doc_id",
        F.xxhash64(_text("text")).alias("doc_key"),
        F.filter(lines, lambda x: x["line"] != "").alias("filled"),
    ).where(F.size("filled") >= size)

    def window(i: Column) -> Column:
        own = [F.get("filled", i + F.lit(k)) for k in range(size)]
        parts = [x["line"] for x in own]
        return F.struct(
            F.xxhash64(*parts).alias("h1"),
            F.xxhash64(F.lit("second"), *parts).alias("h2"),
            own[0]["at"].alias("first"),
            own[-1]["at"].alias("last"),
        )

    each = F.transform(F.sequence(F.lit(0), F.size("filled") - size), window)
    return filled.select("doc_id", "doc_key", F.explode(each).alias("w")).select("doc_id", "doc_key", "w.*")


def covered_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """``(doc_id, doc_key, ranges)``: sorted line ranges of later occurrences per text."""
    windows = _windows(pick(docs, doc_id=id_col, text=text_col), size)
    place = F.struct("doc_id", "doc_key", "first")
    firsts = (
        windows.groupBy("h1", "h2")
        .agg(F.min(place).alias("origin"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .drop("n")
        .hint("rebalance")  # the join below then shuffles both sides anew, and AQE may split hot keys
    )
    later = windows.join(firsts, ["h1", "h2"]).where(place > F.col("origin"))
    return later.groupBy("doc_id", "doc_key").agg(
        F.array_sort(F.collect_set(F.struct("first", "last"))).alias("ranges")
    )


def _kept_lines(lines: Column, ranges: Column) -> Column:
    """The lines outside ``ranges`` (sorted by both ends): the gaps between neighbours."""

    def gap(k: Column) -> Column:
        begin = F.when(k == 0, F.lit(0)).otherwise(F.get(ranges, k - 1)["last"] + 1)
        end = F.when(k == F.size(ranges), F.size(lines)).otherwise(F.get(ranges, k)["first"])
        return F.slice(lines, begin + 1, F.greatest(end - begin, F.lit(0)))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(ranges)), gap))


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = WINDOW,
    removed_col: str | None = None,
    length_col: str | None = None,
    drop_emptied: bool = False,
) -> DataFrame:
    """``docs`` with the lines of repeated windows removed, other columns unchanged.

    A window is ``size`` consecutive non-blank lines, compared without leading
    and trailing ASCII white space (a carriage return, too). Texts are ordered by id (null first), then text hash;
    the first occurrence of a window stays (as far as no other window covers
    it), later ones go, in the same text, too. Blank lines inside a
    removed range go with it. Rows that share id and text are one text:
    neither is later than the other, and both change alike. Null texts and
    texts of fewer than ``size`` non-blank lines stay as they are; a text that
    loses every line becomes empty. An empty table gives an empty result.

    ``removed_col`` adds the number of removed lines; ``length_col`` names an
    existing column that is set to the new text's length where lines went;
    ``drop_emptied`` drops rows whose every line went (whole copies).
    """
    ranges = covered_ranges(docs, id_col, text_col, size).select(
        F.col("doc_id").alias("_range_id"), F.col("doc_key").alias("_range_key"), F.col("ranges").alias("_ranges")
    )
    plain, private = with_keys(docs, _id=id_col, _text=text_col)
    same = F.col("_id").eqNullSafe(F.col("_range_id")) & (F.xxhash64(_text("_text")) == F.col("_range_key"))
    joined = plain.join(ranges, same, "left")
    split = joined.withColumn("_lines", F.when(F.col("_ranges").isNotNull(), F.split(_text("_text"), "\n")))
    split = split.withColumn("_kept", _kept_lines(F.col("_lines"), F.col("_ranges")))
    hit = F.col("_ranges").isNotNull()
    if drop_emptied:
        split = split.where(~hit | (F.size("_kept") > 0))
    text = private[position(docs, text_col)]
    out = split.withColumn(text, F.when(hit, F.array_join("_kept", "\n")).otherwise(F.col(text)))
    if length_col is not None:
        length = private[position(docs, length_col)]
        kind = docs.schema[position(docs, length_col)].dataType
        out = out.withColumn(length, F.when(hit, F.length(text).cast(kind)).otherwise(F.col(length)))
    if removed_col is None:
        return restore(out, private, docs)
    gone = F.when(hit, F.size("_lines") - F.size("_kept")).otherwise(F.lit(0)).cast("long")
    return out.withColumn("_gone", gone).select(*private, "_gone").toDF(*docs.columns, removed_col)
