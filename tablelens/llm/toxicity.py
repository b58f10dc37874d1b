"""Counterfactual-regularised toxicity classifier.

Features are the distinct words of a text and their first 3, 4 and 5 letters;
the features that depart most from independence of the label (G statistic) are
kept. The model is a ridge logistic regression with one more penalty: each
labelled sentence that holds identity terms is written again with each term
swapped for another of its group, and the squared change of the score between the
two is charged. Both labels weigh the same in all, since toxic texts are rare. The weights of identity terms are thereby pulled together, and
a term that is common in toxic training texts does not make a neutral mention of
its group toxic (counterfactual logit pairing, Garg et al. 2019).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.llm.common import pick, slices, sql_type, text_pieces
from tablelens.llm.samples import id_remainder, labelled_sample, newton_logistic

#: Bound on the labelled rows that the model is fitted on, and on its features.
SAMPLE, FEATURES = 10_000, 600
#: Least number of sampled texts with a feature; strengths of the two penalties.
LEAST_TEXTS, RIDGE, COUNTERFACTUAL = 3, 0.3, 1.0
PREFIXES = (3, 4, 5)

# Groups of identity terms that are swapped for each other.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "natives", "locals"),
    ("disabled", "deaf", "blind", "elderly", "young"),
)

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> set[str]:
    return set().union(*(_WORD.findall(p.lower()) for p in text_pieces(text)))


def features_of(words: set[str]) -> set[str]:
    """The words, and their beginnings as ``n:letters``."""
    return words.union(*({f"{n}:{w[:n]}" for w in words if len(w) >= n} for n in PREFIXES))


def sentences_of(text: str) -> list[str]:
    return [s for s in re.split(r"(?<=[.!?])\s+|\n+", text) if s]


def swaps(words: set[str], groups: Sequence[Sequence[str]]) -> Iterator[set[str]]:
    """``words`` with all identity terms swapped for the next of their groups, by one step, two, ..."""
    turns = max((len(g) for g in groups if words & set(g)), default=1)
    for step in range(1, turns):
        turned = set(words)
        for g in groups:
            turned -= set(g)
            turned |= {g[(i + step) % len(g)] for i, t in enumerate(g) if t in words}
        if turned != words:
            yield turned


@dataclass(frozen=True)
class Model:
    features: tuple[str, ...]
    weights: tuple[float, ...]  # one for each feature, then the intercept

    def scorer(self):
        """A function from a text to its score; each word is looked up by word and by beginnings."""
        by_word = {f: w for f, w in zip(self.features, self.weights, strict=False) if ":" not in f}
        starts = [
            (n, {f[2:]: w for f, w in zip(self.features, self.weights, strict=False) if f.startswith(f"{n}:")})
            for n in PREFIXES
        ]
        intercept = self.weights[-1]

        def score(text: str) -> float:
            words = words_of(text)
            parts = [intercept, *(by_word[w] for w in by_word.keys() & words)]
            for n, known in starts:
                parts += [known[p] for p in known.keys() & {w[:n] for w in words}]
            z = math.fsum(parts)  # whatever the order of a set
            return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

        return score


def _feature_counts(sample: DataFrame) -> DataFrame:
    """``(feature, n, n_toxic)``: texts of the sample with each feature."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            every, toxic = Counter(), Counter()
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                some = features_of(words_of(text))
                every.update(some)
                if label:
                    toxic.update(some)
            made = [pa.array(list(every)), pa.array(list(every.values())), pa.array([toxic[f] for f in every])]
            yield pa.RecordBatch.from_arrays([m.cast(k) for m, k in zip(made, kinds, strict=True)], ["feature", "n", "n_toxic"])

    kinds = [pa.string(), pa.int64(), pa.int64()]
    counts = sample.mapInArrow(count, "feature string, n bigint, n_toxic bigint")
    return counts.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic"))


def _g_statistic(n: Column, k: Column, total: int, toxic: int) -> Column:
    """G over the two cells of texts with a feature: observed against expected."""

    def cell(seen: Column, share: float) -> Column:
        return F.when(seen > 0, seen * F.ln(seen / (n * F.lit(share)))).otherwise(F.lit(0.0))

    return 2 * (cell(k, toxic / total) + cell(n - k, (total - toxic) / total))


def _counterfactual_products(sample: DataFrame, number: dict[str, int], groups: Sequence[Sequence[str]]) -> tuple[np.ndarray, int]:
    """Sum over all pairs of the outer product of their change in features, and the number of pairs.

    Each task adds up its own pairs in one matrix of the features' size and
    hands on the upper triangle's cells that are not zero; they are whole
    numbers, so their sum is the same in any order. A pair without a change
    counts nowhere.
    """
    size = len(number)
    terms = {t for g in groups for t in g}

    def vector(words: set[str]) -> set[int]:
        return {number[f] for f in features_of(words) & number.keys()}

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, pairs = np.zeros((size, size), dtype=np.int64), 0
        for b in slices(batches):
            for text in b.column(0).to_pylist():
                if terms.isdisjoint(words_of(text)):
                    continue
                for s in sentences_of(text):
                    here = words_of(s)
                    before = None
                    for turned in swaps(here, groups):
                        before, after = vector(here) if before is None else before, vector(turned)
                        if before != after:
                            at = [*(before - after), *(after - before)]
                            sign = np.array([1] * len(before - after) + [-1] * len(after - before))
                            total[np.ix_(at, at)] += np.outer(sign, sign)
                            pairs += 1
        i, j = np.nonzero(np.triu(total))
        columns = [[*i.tolist(), size], [*j.tolist(), size], [*total[i, j].tolist(), pairs]]  # the last is the count
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["i", "j", "n"])

    cells = sample.select("text").mapInArrow(add, "i bigint, j bigint, n bigint").groupBy("i", "j").agg(F.sum("n").alias("n"))
    i, j, n = (c.to_numpy() for c in cells.toArrow().columns)  # at most size * (size + 1) / 2 + 1 rows
    both = np.zeros((size + 1, size + 1))
    both[i, j] = both[j, i] = n
    return both[:size, :size], int(both[size, size])


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    learn: Column | None = None,
    sample_limit: int = SAMPLE,
    max_features: int = FEATURES,
    identity_terms: Sequence[Sequence[str]] = IDENTITY_TERMS,
    ridge: float = RIDGE,
    counterfactual: float = COUNTERFACTUAL,
) -> Model:
    """Fit on at most ``sample_limit`` labelled rows (see ``labelled_sample``).

    Without labels of both kinds the model has no features, and its score is
    the share of toxic labels (one half without labels).
    """
    sample = labelled_sample(docs, labels, label_col, sample_limit, id_col, text_col, learn)
    sample = sample.select("text", F.col("label").cast("int").alias("label"))
    total, toxic = sample.agg(F.count(F.lit(1)), F.sum((F.col("label") > 0).cast("int"))).first()
    if not total or not toxic or toxic == total:
        rate = (toxic or 0) / total if total else 0.5
        rate = min(max(rate, 0.01), 0.99)
        return Model((), (float(np.log(rate / (1 - rate))),))
    score = _g_statistic(F.col("n"), F.col("n_toxic"), total, toxic)
    best = (
        _feature_counts(sample)
        .where(F.col("n") >= LEAST_TEXTS)
        .select("feature", score.alias("g"))
        .orderBy(F.desc("g"), "feature")
        .limit(max_features)
        .collect()
    )
    features = tuple(r["feature"] for r in best)
    number = {f: i for i, f in enumerate(features)}

    def vector(words: set[str]) -> list[int]:
        return sorted(number[f] for f in features_of(words) & number.keys())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            own = [vector(words_of(text)) for text in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.int32())), b.column(1)], ["own", "label"])

    # At most sample_limit rows of at most max_features numbers; in one order, so that fits repeat to the last bit.
    rows = sorted(sample.mapInArrow(encode, "own array<int>, label int").collect(), key=lambda r: (r["own"], r["label"]))
    x = np.zeros((len(rows), len(features)))
    for i, r in enumerate(rows):
        x[i, r["own"]] = 1
    products, pairs = _counterfactual_products(sample, number, identity_terms)
    y = np.array([r["label"] > 0 for r in rows], dtype=float)
    return Model(features, tuple(newton_logistic(x, y, ridge, products, pairs, counterfactual, balance=True).tolist()))


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score, predicted)`` of every row's whole text; null texts count as empty.

    ``predicted`` is 1 from a score of one half. The model has at most
    ``FEATURES`` weights and goes with the task.
    """
    d = pick(docs, doc_id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for b in slices(batches):
            s = [score(t or "") for t in b.column(1).to_pylist()]
            made = [pa.array(s, pa.float64()), pa.array([int(v >= 0.5) for v in s], pa.int32())]
            yield pa.RecordBatch.from_arrays([b.column(0), *made], ["doc_id", "score", "predicted"])

    return d.mapInArrow(run, f"doc_id {sql_type(d, 'doc_id')}, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, held_out_of: int = 5, **settings) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row.

    Ids with crc32 (as text) divisible by ``held_out_of``, and null ids, are
    held out of learning. Repeated ids are scored row by row; an empty table
    gives an empty result.
    """
    model = fit_toxicity(docs, labels, learn=id_remainder(F.col("doc_id"), held_out_of) != 0, **settings)
    scored = score_toxicity(docs, model)
    out = F.coalesce(id_remainder(F.col("doc_id"), held_out_of) == 0, F.lit(True))
    return scored.select("doc_id", out.alias("held_out"), "score", "predicted")
