"""Corpus pipeline: five stages from raw documents to packed token sequences.

Each stage is ``(name, function)``; a function takes ``(spark, docs, sf_dir)``
and returns a DataFrame, which is written as Parquet in the shared folder and
reread as the next stage's ``docs``. All stages but the last return the columns
of ``documents``. Extra columns pass through; empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablelens.llm.common import stage
from tablelens.llm.decontaminate import decontaminated
from tablelens.llm.linededup import dedup_lines
from tablelens.llm.packing import pack_documents
from tablelens.llm.queries import public_tokenizer, quality_scores
from tablelens.llm.quality import keep_good
from tablelens.llm.simhash import keep_one_per_component
from tablelens.sources.tables import read_parquet


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior quality is at least one half stay."""
    return keep_good(docs, quality_scores(docs, read_parquet(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go, ``n_chars`` follows the text."""
    return dedup_lines(docs, length_col="n_chars", drop_emptied=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component the document with the smallest id stays."""
    return keep_one_per_component(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which a benchmark item leaks go."""
    return decontaminated(docs, read_parquet(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens."""
    return pack_documents(docs, public_tokenizer())


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: The classifier, SimHash and the tokenizer have no SQL form; line dedup,
#: near-dedup and decontamination are tested against brute force on their own
#: input, quality on labelled documents, packing by the tokenizer's ids, and ``run``
#: against the stages called one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_parquet(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
