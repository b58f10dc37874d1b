"""Delimited text sources.

Every cell is read as text: typing is a separate, explicit step
(``operators.roles``) so that numeric grammar and null tokens stay under the
library's control rather than the reader's inference.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.sources.records import has_line_breaks, records


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """Tab if the first line holds more tabs than commas, else comma.

    Reads one line (a ``limit(1)`` job touching one split), never the file.
    """
    first = spark.read.text(path).limit(1).collect()
    if not first:
        return ","
    line = first[0][0] or ""
    return "\t" if line.count("\t") > line.count(",") else ","


#: Quoted cells with doubled quotes; short rows padded, long rows cut.
CELLS = {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}


def cells_of(record: str, columns: int, sep: str) -> Column:
    """A record's text cells as a struct ``_0, _1, ...``, as Spark's reader splits them."""
    return F.from_csv(record, ", ".join(f"_{i} string" for i in range(columns)), CELLS | {"sep": sep, "multiLine": "true"})


def read_table(
    spark: SparkSession,
    path: str,
    sep: str | None = None,
    multi_line: bool = False,
    encoding: str = "UTF-8",
    nulls: str | Iterable[str] | None = None,
    row_seq: str | None = None,
    line_breaks: bool | None = None,
) -> DataFrame:
    """Header-row delimited text as an all-string DataFrame.

    * ``sep=None`` sniffs the delimiter from the first line (S2).
    * Double-quote quoting with doubled quotes inside quoted cells.
    * Header names are stripped of surrounding whitespace (S4).
    * Short rows are padded with NULL and long rows cut (``PERMISSIVE``, S5).
    * Empty cells are NULL. ``nulls`` applies a null-token policy
      (``"strict"``, ``"folded"``, ``"empty"`` or a token list, see
      ``operators.clean.normalise_nulls``) as a column expression.
    * ``row_seq`` names a column holding the file order, since Spark rows have
      no order otherwise: a struct of file path, start of the split in the
      file, and position in the split, which sorts by path and then as the
      lines do. It is the ``order_by`` of "first groups", prefix samples and
      the reports, which leave it out of typing, profiles and dedup.

    Quoted cells may hold line breaks, and files are split all the same
    (``sources.records``). By default (``line_breaks=None``) one scan looks for
    a line that ends inside a cell; it stops at the first, and without one the
    files go through Spark's reader by lines. ``True`` skips that look,
    ``False`` says that there are none. ``multi_line=True`` has Spark's reader
    take each file as one task's work; encodings other than UTF-8 are read so
    unless ``line_breaks=False``. Records read by split end at line feeds.
    """
    sep = sep or sniff_delimiter(spark, path)
    utf8 = encoding.upper().replace("-", "") == "UTF8"
    multi_line = multi_line or not utf8 and line_breaks is not False
    d = (
        spark.read.options(**CELLS)
        .option("sep", sep)
        .option("header", True)
        .option("multiLine", multi_line)
        .option("inferSchema", False)
        .option("encoding", encoding)
        .csv(path)
    )
    names = [c.strip() for c in d.columns]
    if line_breaks is None:
        line_breaks = utf8 and not multi_line and has_line_breaks(spark, path, sep)
    if line_breaks and not multi_line:
        cells = cells_of("record", len(names), sep)
        rows = records(spark, path, sep).where("NOT head").select(cells.alias("cells"), F.struct("path", "split", "line").alias("place"))
        d = rows.select("cells.*", *["place"] * (row_seq is not None)).toDF(*names, *[row_seq] * (row_seq is not None))
    elif row_seq is None:
        d = d.toDF(*names)
    else:
        place = F.struct(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("split"),
            F.monotonically_increasing_id().alias("line"),
        )
        d = d.select("*", place).toDF(*names, row_seq)
    if nulls is not None:
        from tablelens.operators.clean import normalise_nulls

        d = normalise_nulls(d, nulls)
    return d


def write_delimited(d: DataFrame, path: str, sep: str = ",") -> None:
    """Write a frame as header-row delimited text (used to stage fixtures)."""
    (
        d.write.mode("overwrite")
        .option("header", True)
        .option("sep", sep)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )


def first_line_counts(spark: SparkSession, path: str) -> DataFrame:
    """Tabs and commas of the first line as a one-row frame (F5, for inspection)."""
    line = spark.read.text(path).limit(1)
    v = F.col("value")
    return line.select(
        (F.length(v) - F.length(F.regexp_replace(v, "\t", ""))).alias("tabs"),
        (F.length(v) - F.length(F.regexp_replace(v, ",", ""))).alias("commas"),
    )
