"""Hierarchical empirical-Bayes quality classifier.

A ridge logistic regression over shape statistics of a text gives each document
its own evidence p. Hosts and the paths below them are groups of documents:
their rates are shrunk, a path's toward its host's and a host's toward the global
rate, by Beta priors whose strengths are estimated from how much the groups
differ beyond chance (method of moments). A document's posterior log-odds are its
own plus what its path's rate, seen without the document itself, adds to the
global rate. Sparse sites thus stay near the global prior, and only sites with
much consistent evidence move their documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.llm.common import pick, restore, slices, sql_type, stage, text_pieces, with_keys
from tablelens.llm.samples import labelled_sample, newton_logistic

#: Bound on the labelled rows that the classifier is fitted on.
SAMPLE = 8000
RIDGE = 0.1
#: Bounds of a Beta prior's strength in documents, and of a document's own probability.
WEAKEST, STRONGEST, SURE = 2.0, 1e6, 1e-4
_CLIP = 6.0


def shape(text: str) -> list[float]:
    """Statistics of a text's words, characters and lines; zeros for an empty one."""
    counts: Counter[str] = Counter()
    marks = np.zeros(4, dtype=np.int64)  # letters, digits, upper-case letters, full stops and commas
    others = repeats = 0
    last = None
    for part in text_pieces(text):
        words = part.split()
        counts.update(words)
        repeats += sum(map(str.__eq__, words, words[1:])) + (bool(words) and words[0] == last)
        last = words[-1] if words else last
        code = np.frombuffer(part.encode("utf-32-le"), dtype=np.uint32)
        folded = code | 32
        letter = ((folded >= 97) & (folded <= 122)) | (code >= 0xC0)
        digit = (code >= 48) & (code <= 57)
        space = (code == 32) | ((code >= 9) & (code <= 13))
        stop = (code == 46) | (code == 44)
        upper = (code >= 65) & (code <= 90)
        marks += [letter.sum(), digit.sum(), upper.sum(), stop.sum()]
        others += len(code) - int((letter | digit | space | stop).sum())
    if not counts:
        return [0.0] * 11
    n, total = counts.total(), len(text)
    lines = text.split("\n")
    return [
        math.log(n),
        total / n / 10,
        *(marks / total).tolist(),
        others / total,
        len(counts) / n**0.8,
        repeats / n,
        len(set(lines)) / len(lines),
        max(counts.values()) / n,
    ]


class ShapeModel:
    """Standardised statistics and their squares in a logistic regression."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        both = len(y) and 0 < y.mean() < 1
        self.mean = x.mean(axis=0) if both else np.zeros(11)
        self.scale = x.std(axis=0) + 1e-9 if both else np.ones(11)
        self.w = newton_logistic(self._terms(x), y, RIDGE) if both else None
        self.rate = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5

    def _terms(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -_CLIP, _CLIP)
        return np.hstack([z, z * z])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.w is None:  # labels of one kind or none
            return np.full(len(x), self.rate)
        t = self._terms(x)
        z = t @ self.w[:-1] + self.w[-1]
        return np.clip(1 / (1 + np.exp(-np.clip(z, -30, 30))), SURE, 1 - SURE)


def fit_shape(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample_limit: int = SAMPLE,
) -> ShapeModel:
    """Fit on at most ``sample_limit`` labelled rows (see ``labelled_sample``)."""
    sample = labelled_sample(docs, labels, label_col, sample_limit, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = pa.array([shape(t) for t in b.column(0).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([x, b.column(1)], ["x", "label"])

    rows = sample.select("text", F.col("label").cast("int").alias("label")).mapInArrow(run, "x array<double>, label int")
    # At most sample_limit rows of eleven numbers; in one order, so that fits repeat to the last bit.
    found = sorted(rows.collect(), key=lambda r: (r["x"], r["label"]))
    x = np.array([r["x"] for r in found]).reshape(-1, 11)
    return ShapeModel(x, np.array([r["label"] > 0 for r in found], dtype=float))


def own_evidence(docs: DataFrame, model: ShapeModel) -> DataFrame:
    """``docs`` (with ``doc_id, doc_key, text, host, path``) with ``p`` instead of the text."""
    names = ["doc_id", "doc_key", "host", "path", "p"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = np.array([shape(t) for t in b.column(4).to_pylist()]).reshape(-1, 11)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(model(x))], names)

    kinds = f"doc_id {sql_type(docs, 'doc_id')}, doc_key bigint, host string, path string, p double"
    return docs.select("doc_id", "doc_key", "host", "path", "text").mapInArrow(run, kinds)


def _strength(groups: DataFrame, rate: float) -> float:
    """Documents that a Beta prior around ``rate`` is worth, by the method of moments.

    ``groups`` has ``n`` and ``s`` (sum of p). The variance of group rates,
    weighted by size, less what chance alone makes, is what groups truly
    differ by.
    """
    g = F.col("n") * F.pow(F.col("s") / F.col("n") - F.lit(rate), 2)
    total, squares, spread, k = groups.agg(
        F.sum("n"), F.sum(F.pow("n", F.lit(2))), F.sum(g), F.count(F.lit(1))
    ).first()
    chance = rate * (1 - rate)
    if not total or k < 2 or chance <= 0:
        return STRONGEST
    true = (spread - (k - 1) * chance) / (total - squares / total)
    return float(np.clip(chance / true - 1, WEAKEST, STRONGEST)) if true > 0 else STRONGEST


def _within_strength(sums: DataFrame) -> float:
    """Documents that a path's Beta prior around its host's rate is worth, by the method of moments within hosts.

    ``sums`` has a row per path with its own and its host's count and sum of p.
    Paths are measured around their own host's rate, so what hosts differ by
    is no difference between paths; a host with one path tells nothing.
    """
    m = F.col("host_s") / F.col("host_n")
    chance = m * (1 - m)
    rest = 1 - F.col("path_n") / F.col("host_n")  # adds up to the host's number of paths less one
    spread, expected, room, each, total = sums.agg(
        F.sum(F.col("path_n") * F.pow(F.col("path_s") / F.col("path_n") - m, 2)),
        F.sum(chance * rest),
        F.sum(F.col("path_n") * rest),
        F.sum(F.col("path_n") * chance),
        F.sum("path_n"),
    ).first()
    if not total or room <= 0 or each <= 0:
        return STRONGEST
    true = (spread - expected) / room
    return float(np.clip(each / total / true - 1, WEAKEST, STRONGEST)) if true > 0 else STRONGEST


def _logit(p: Column) -> Column:
    return F.ln(p / (1 - p))


def quality_posteriors(
    docs: DataFrame,
    labels: DataFrame,
    host: Column,
    path: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample_limit: int = SAMPLE,
) -> DataFrame:
    """Posterior quality of every row's whole text.

    ``host`` and ``path`` are string expressions over the columns of ``docs``.
    Columns: ``doc_id, doc_key`` (a hash of the text), ``host, path, p`` (the
    classifier's own probability), ``host_rate, path_rate`` (posterior means,
    the document itself left out of both), ``quality`` (posterior
    probability) and ``keep`` (1 from one half).

    Null texts count as empty; null hosts and paths are groups of their own;
    rows are scored one by one, so ids may repeat or be null. Labels of one
    kind only, or none, give every document the same own evidence. An empty
    table gives an empty result. Groups are reduced to a count and a sum before the
    shuffle.
    """
    model = fit_shape(docs, labels, id_col, text_col, label_col, sample_limit)
    placed = docs.select(host.cast("string").alias("host"), path.cast("string").alias("path"), docs["*"])
    d = pick(placed, host="host", path="path", doc_id=id_col, text=text_col)
    d = d.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("doc_key", F.xxhash64("text"))
    scored = stage(own_evidence(d, model), "quality-evidence")
    paths = stage(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s")), "quality-paths")
    hosts = stage(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")), "quality-hosts")
    n, s = hosts.agg(F.sum("n"), F.sum("s")).first()
    rate = float(np.clip((s or 0.0) / n, SURE, 1 - SURE)) if n else 0.5
    sums = paths.alias("a").join(hosts.alias("b"), F.col("a.host").eqNullSafe(F.col("b.host"))).select(
        F.col("a.host").alias("g_host"),
        F.col("a.path").alias("g_path"),
        F.col("a.n").alias("path_n"),
        F.col("a.s").alias("path_s"),
        F.col("b.n").alias("host_n"),
        F.col("b.s").alias("host_s"),
    )
    sums = stage(sums, "quality-sums")
    host_prior, path_prior = _strength(hosts, rate), _within_strength(sums)
    same = F.col("host").eqNullSafe(F.col("g_host")) & F.col("path").eqNullSafe(F.col("g_path"))
    joined = scored.join(sums, same)
    p = F.col("p")
    host_rate = (F.col("host_s") - p + host_prior * rate) / (F.col("host_n") - 1 + host_prior)
    path_rate = (F.col("path_s") - p + path_prior * F.col("host_rate")) / (F.col("path_n") - 1 + path_prior)
    bounded = F.least(F.greatest(F.col("path_rate"), F.lit(SURE)), F.lit(1 - SURE))
    odds = _logit(p) + _logit(bounded) - F.lit(math.log(rate / (1 - rate)))
    return (
        joined.withColumn("host_rate", host_rate)
        .withColumn("path_rate", path_rate)
        .withColumn("quality", 1 / (1 + F.exp(-odds)))
        .select(
            "doc_id", "doc_key", "host", "path", "p", "host_rate", "path_rate", "quality",
            (F.col("quality") >= 0.5).cast("int").alias("keep"),
        )
    )


def keep_good(docs: DataFrame, posteriors: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not rejected, all columns as they were.

    Rows that share id and text go if any of them is rejected (their hosts may differ).
    """
    bad = posteriors.where("keep = 0").select(F.col("doc_id").alias("_bad"), F.col("doc_key").alias("_bad_key")).distinct()
    plain, private = with_keys(docs, _id=id_col, _text=text_col)
    same = F.col("_id").eqNullSafe(F.col("_bad")) & (F.xxhash64(F.coalesce("_text", F.lit(""))) == F.col("_bad_key"))
    return restore(plain.join(bad, same, "left_anti"), private, docs)
