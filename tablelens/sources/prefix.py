"""First rows of files in path order, reading no more files than they fill.

Spark rows have no order of their own; files have: by path, and inside a file
by place. A prefix therefore takes the files in path order, twice as many each
time, until they hold the rows that are wanted, and the frame it returns scans
those files alone. Delimited files have no row counts to look up: their lines
are taken from the first split of a file on (``take`` runs one task, then four
times as many), and the few lines that make up the prefix become the frame.
"""

from __future__ import annotations

import csv
from collections.abc import Callable, Iterator, Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.functions.nulls import col_of
from tablelens.operators.roles import numeric_ratios, role_of_ratios
from tablelens.sources.delimited import cells_of, sniff_delimiter

#: Rows of the prefixes that are tried before a whole scan.
PREFIXES = (1_000, 16_000)


def files_of(d: DataFrame) -> list[str]:
    """The files of a scan in path order, as paths to read."""
    return [unquote(f) for f in sorted(d.inputFiles())]


def first_file_rows(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The first ``n`` rows of Parquet files, in path order and by place in the file.

    The number of files is settled from their row counts (footers alone); the
    frame's scan has these files only. Fewer rows than ``n`` are all rows.
    """
    whole = spark.read.parquet(path)
    files = files_of(whole)
    count, held = 1, 0
    while files:
        held = spark.read.schema(whole.schema).parquet(*files[:count]).count()
        if held >= n or count >= len(files):
            break
        count *= 2
    if not files:
        return whole.limit(0)
    some = spark.read.schema(whole.schema).parquet(*files[:count])
    return some.orderBy("_metadata.file_path", "_metadata.row_index").limit(n)


def _first_records(spark: SparkSession, path: str, n: int, sep: str) -> Iterator[list[str]]:
    """Records of delimited files in path order, ``n`` at most without the heads, as lists of lines; first the head."""
    files = files_of(spark.read.text(path))
    got, headed = 0, False
    for file in files:
        lines, wanted = spark.read.option("lineSep", "\n").text(file), n - got + 1
        while True:
            taken = [r[0] for r in lines.take(wanted)]
            found = list(_joined(taken, sep))
            whole = len(taken) < wanted
            if whole or len(found) > n - got + 1:  # the last record may still be open
                break
            wanted *= 4
        for record in found[1 if headed else 0 : n - got + 1]:
            yield record
        got += max(0, min(len(found), n - got + 1) - 1)
        headed = True
        if got >= n:
            return


def _joined(lines: Sequence[str], sep: str) -> Iterator[list[str]]:
    """Lines of each record, blank lines outside cells left out."""
    read: list[str] = []

    def each() -> Iterator[str]:
        for line in lines:
            read.append(line)
            yield line + "\n"

    for cells in csv.reader(each(), delimiter=sep):
        record, read[:] = list(read), []
        if cells and any(line.strip() for line in record):
            yield record


def first_records(spark: SparkSession, path: str, n: int, sep: str | None = None, row_seq: str | None = None) -> DataFrame:
    """The first ``n`` rows of header-row delimited files, in path order, as ``read_table`` reads them.

    Reads the first lines of as few files as hold ``n`` records (line breaks
    inside quoted cells belong to them). The rows themselves, ``n`` at most,
    pass through the driver, as with ``take``. ``row_seq`` names a column with
    their numbers from 0.
    """
    sep = sep or sniff_delimiter(spark, path)
    records = ["\n".join(lines).removesuffix("\r") for lines in _first_records(spark, path, n, sep)]
    if not records:
        return spark.createDataFrame([], "_ string").drop("_")
    names = [c.strip() for c in next(csv.reader(records[0].splitlines(keepends=True), delimiter=sep))]
    rows = spark.createDataFrame(list(enumerate(records[1:])), "place long, record string")
    d = rows.select(cells_of("record", len(names), sep).alias("cells"), "place").select("cells.*", *["place"] * (row_seq is not None))
    return d.toDF(*names, *[row_seq] * (row_seq is not None))


def prefix_role_table(
    first: Callable[[int], DataFrame],
    whole: Callable[[], DataFrame],
    order_by: str,
    sample_values: int | None = None,
    sample_rows: int | None = None,
    threshold: float = 0.8,
    inclusive: bool = False,
    force_text: Sequence[str] = (),
    prefixes: Sequence[int] = PREFIXES,
) -> DataFrame:
    """``role_table`` on a prefix sample that reads only the prefix.

    ``first(n)`` gives the first n rows, ``whole()`` all of them; both hold
    ``order_by``, which is no column of the data. ``sample_rows`` judges the
    first rows. ``sample_values`` judges each column's first non-null values:
    growing prefixes settle the columns that have enough of them, and only
    columns that still lack some are looked for in the whole table.
    """

    def ratios(d: DataFrame, cols: list[str]) -> DataFrame:
        return numeric_ratios(d, cols, sample_values=sample_values, order_by=order_by)

    if sample_rows is not None:
        d = first(sample_rows)
        cols = [c for c in d.columns if c != order_by]
        return role_of_ratios(numeric_ratios(d, cols), threshold, inclusive, force_text)
    for n in prefixes:
        d = first(n)
        cols = [c for c in d.columns if c != order_by]
        counts = d.agg(F.count(F.lit(1)), *[F.count(col_of(c)) for c in cols]).first()
        short = [c for c, k in zip(cols, counts[1:], strict=True) if k < sample_values]
        if not short or counts[0] < n:
            return role_of_ratios(ratios(d, cols), threshold, inclusive, force_text)
    settled = [c for c in cols if c not in short]
    found = ratios(whole(), short)
    if settled:
        found = found.unionByName(ratios(d, settled))
    place = F.create_map(*[x for i, c in enumerate(cols) for x in (F.lit(c), F.lit(i))])
    return role_of_ratios(found.withColumn("position", place[F.col("column_name")]), threshold, inclusive, force_text)
