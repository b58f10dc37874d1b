"""Bounded, repeatable training samples and small model fits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.llm.common import pick, stage


def id_remainder(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n`` (null for a null id)."""
    return F.crc32(id_col.cast("string").cast("binary")) % F.lit(n)


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str,
    limit: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    learn: Column | None = None,
) -> DataFrame:
    """``(text, label)`` of at most ``limit`` labelled documents, staged.

    The sample takes the different ``(id, label)`` pairs with the smallest
    hashes of their ids, so it is the same in every run. ``learn`` (over
    ``doc_id``) says which ids may be learned from. Null labels and ids are left
    out. A text counts once for each different label of its id, however often
    the labels repeat. An id may have any number of texts: where they make more
    than ``limit`` rows, those with the smallest hashes of id, text and label
    stay. Only the pairs, at most ``limit``, are broadcast.
    """
    d = pick(docs, doc_id=id_col, text=text_col)
    rows = pick(labels, doc_id=id_col, label=label_col).where("doc_id IS NOT NULL AND label IS NOT NULL")
    if learn is not None:
        rows = rows.where(learn)
    chosen = _smallest_pairs(rows, limit)
    if d.select("doc_id").join(F.broadcast(chosen), "doc_id").count() > limit:
        found = _smallest_rows(d.join(F.broadcast(chosen), "doc_id"), limit)
    else:
        found = d.join(F.broadcast(chosen), "doc_id")
    return stage(found.select(F.coalesce("text", F.lit("")).alias("text"), "label"), "labelled")


def _smallest_pairs(rows: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` different rows of ``(doc_id, label)`` by hash of the id, staged.

    If the first ``limit`` rows all differ they are the answer, and no row moves;
    only repeated ones call for a shuffle of all.
    """
    order = [F.xxhash64(F.col("doc_id").cast("string")), F.col("doc_id"), F.col("label")]
    first = stage(rows.orderBy(*order).limit(limit), "labels")
    n, different = first.agg(F.count(F.lit(1)), F.count_distinct("doc_id", "label")).first()
    if n == different:
        return first
    if n < limit:
        return first.distinct()
    return stage(rows.distinct().orderBy(*order).limit(limit), "labels")


def _smallest_rows(found: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` rows of ``(doc_id, text, label)`` with the smallest hashes.

    The first pass ranks hashes alone; the second takes the texts up to the last
    one. Rows that share the last hash are copies, so any of them will do.
    """
    keyed = found.withColumn("key", F.xxhash64(F.col("doc_id").cast("string"), "text", "label"))
    first = keyed.select("key").orderBy("key").limit(limit)
    last, n = first.groupBy("key").agg(F.count(F.lit(1))).orderBy(F.desc("key")).first()
    return keyed.where(F.col("key") < last).unionByName(keyed.where(F.col("key") == last).limit(n)).drop("key")


def newton_logistic(
    x: np.ndarray,
    y: np.ndarray,
    l2: float,
    products: np.ndarray | None = None,
    pairs: int = 0,
    weight: float = 0.0,
    balance: bool = False,
    steps: int = 25,
) -> np.ndarray:
    """Weights (the intercept last) of a ridge logistic regression by Newton's method.

    With ``balance`` both labels weigh the same in all. ``products`` is the sum of
    the outer products of ``pairs`` rows (without intercept) whose product with
    the weights should be zero; ``weight`` times the mean square of these
    products is added to the loss.
    """
    x = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.full(x.shape[1], l2)
    ridge[-1] = 1e-6
    extra = np.zeros((x.shape[1], x.shape[1]))
    if products is not None and pairs:
        extra[:-1, :-1] = weight * products * (len(x) / pairs)
    w = np.zeros(x.shape[1])
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3) if len(y) else 0.5
    each = np.where(y > 0, 0.5 / rate, 0.5 / (1 - rate)) if balance else np.ones(len(y))
    w[-1] = 0.0 if balance else np.log(rate / (1 - rate))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (each * (p - y)) + ridge * w + extra @ w
        curve = (x * (each * p * (1 - p))[:, None]).T @ x + extra + np.diag(ridge)
        move = np.linalg.solve(curve, slope)
        w -= move
        if np.abs(move).max() < 1e-6:
            break
    return w
