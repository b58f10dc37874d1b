"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import tablelens
from tablelens.session import shared_dir

_carried: set[str] = set()
_SPACE = re.compile(r"\s")


def carry_package(spark: SparkSession) -> None:
    """Send this library's source to the executors' Python workers, once per application.

    Functions that run there are found by module name, and a cluster need not
    have the library installed.
    """
    context = spark.sparkContext
    root = Path(tablelens.__file__).parent
    if context.applicationId in _carried or not root.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="tablelens-code-")) / "tablelens-code.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(str(archive))
    _carried.add(context.applicationId)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Project ``df`` to ``new_name=old_name`` columns by position.

    An exact match of the old name wins over one that differs in case, and the
    first of several equal names is taken, so other columns of ``df`` never
    make a reference ambiguous whatever they are called.
    """
    carry_package(df.sparkSession)
    plain = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"_c{position(df, old)}").alias(new) for new, old in columns.items()])


def position(df: DataFrame, name: str) -> int:
    """Index of column ``name``: exact match first, then ignoring case."""
    if name in df.columns:
        return df.columns.index(name)
    lowered = [c.lower() for c in df.columns]
    if name.lower() in lowered:
        return lowered.index(name.lower())
    raise ValueError(f"no column {name!r} among {df.columns}")


def with_keys(df: DataFrame, **keys: str) -> tuple[DataFrame, list[str]]:
    """All columns of ``df`` under private names ``_c0..`` plus ``new=old`` copies.

    The second value lists the private names in order; ``restore`` turns a
    frame that still holds them back into the columns of ``df``.
    """
    private = [f"_c{i}" for i in range(len(df.columns))]
    plain = df.toDF(*private)
    return (
        plain.select("*", *[F.col(f"_c{position(df, old)}").alias(new) for new, old in keys.items()]),
        private,
    )


def restore(plain: DataFrame, private: list[str], like: DataFrame) -> DataFrame:
    """Undo ``with_keys``: the private columns under the names of ``like``."""
    return plain.select(*private).toDF(*like.columns)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it back.

    Cuts the lineage with files that every executor can read, so a lost
    executor costs a re-read instead of a recomputation.
    """
    target = shared_dir(df.sparkSession, name)
    df.write.parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)


def sql_type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def text_pieces(text: str, size: int = 1 << 20) -> Iterator[str]:
    """``text`` in order, cut before white space about every ``size`` characters.

    No word crosses a cut, so the words of a very long text can be gone
    through without holding all of them.
    """
    at = 0
    while at < len(text):
        cut = _SPACE.search(text, at + size)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in zero-copy slices, so Python objects of few texts exist at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
