"""Document fingerprints: threshold-scaled sketches of shingle hashes.

A sketch keeps every 64-bit shingle hash below a fixed fraction of the hash
range (the scaled MinHash of Irber et al. and Broder's "mod m" sketches). The
threshold is the same for every document, so the sketch of a union is the union
of the sketches, and containment estimates stay unbiased between documents of
very unequal length. They use hashes below the threshold alone, and are unknown
(null) where the contained document has none.

Of a text with at most ``WHOLE`` distinct shingles the sketch keeps every hash
and is marked as whole. Whole sketches compare exactly, and ``probe`` counts the
hashes of one in the text of any other document, so short texts, of which a
threshold would keep too little to say anything, are not lost. A merged sketch
stays whole as long as the union is so small.

As text a sketch is its sorted hashes, 16 lowercase hex digits each, after "="
if it is whole; without words it is empty.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.llm.common import pick, slices, sql_type
from tablelens.llm.simhash import shingle_hashes

#: Words per shingle and share of the hash range that is kept.
SHINGLE = 5
FRACTION = 0.25
#: Distinct shingles up to which a sketch keeps them all.
WHOLE = 64
#: Range pieces per shuffle partition (small pieces even out hash placement).
PIECES_PER_PARTITION = 4
#: First characters of a text by which rows of one id are told apart in ranges.
_HEAD = 48


def threshold(fraction: float) -> int:
    return int(fraction * 2.0**64)


def _bound(fraction: float) -> str:
    """The threshold as 16 hex digits; hashes sort as text."""
    return f"{min(threshold(fraction), 2**64 - 1):016x}"


@dataclass(frozen=True)
class Sketch:
    hashes: np.ndarray  # ascending
    whole: bool  # every shingle's hash is there

    def kept(self, fraction: float) -> np.ndarray:
        """Hashes below the threshold."""
        return self.hashes[self.hashes < np.uint64(threshold(fraction))] if self.whole and fraction < 1 else self.hashes


def shingle_set(text: str | None, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """Hashes of the lower-cased whole text's word shingles, a chunk at a time.

    Words are separated by white space; a text of fewer than ``shingle`` words
    is one shingle, a null text or one without words has none.
    """
    return shingle_hashes(" ".join((text or "").lower().split()).encode("utf-8"), shingle)


def sketch(text: str | None, shingle: int = SHINGLE, fraction: float = FRACTION) -> Sketch:
    """The sketch of a whole text."""
    kept, few = [np.empty(0, dtype=np.uint64)], np.empty(0, dtype=np.uint64)
    for hashes in shingle_set(text, shingle):
        kept.append(hashes[hashes < np.uint64(threshold(fraction))] if fraction < 1 else hashes)
        if len(few) <= WHOLE:
            few = np.union1d(few, hashes)
    whole = len(few) <= WHOLE
    return Sketch(few if whole else np.unique(np.concatenate(kept)), whole)


def to_text(s: Sketch) -> str:
    return ("=" if s.whole and len(s.hashes) else "") + s.hashes.astype(">u8").tobytes().hex()


def from_text(fingerprint: str) -> Sketch:
    digits = fingerprint.removeprefix("=")
    return Sketch(np.frombuffer(bytes.fromhex(digits), dtype=">u8").astype(np.uint64), len(digits) < len(fingerprint) or not digits)


def likeness(a: Sketch, b: Sketch, fraction: float = FRACTION) -> float | None:
    """Jaccard similarity: exact between whole sketches (two empty ones are alike), else estimated; None if unknown."""
    if a.whole and b.whole:
        x, y = a.hashes, b.hashes
        if not len(x) and not len(y):
            return 1.0
    else:
        x, y = a.kept(fraction), b.kept(fraction)
    common = len(np.intersect1d(x, y, assume_unique=True))
    every = len(x) + len(y) - common
    return common / every if every else None


# ---------------------------------------------------------------- operators


def document_sketches(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    fraction: float = FRACTION,
) -> DataFrame:
    """``(doc_id, fingerprint)`` of every row's whole text; null texts count as empty."""
    d = pick(docs, doc_id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = pa.array((to_text(sketch(t, shingle, fraction)) for t in b.column(1).to_pylist()), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), fp], ["doc_id", "fingerprint"])

    return d.mapInArrow(run, f"doc_id {sql_type(d, 'doc_id')}, fingerprint string")


def is_whole(fingerprint: Column) -> Column:
    return F.startswith(fingerprint, F.lit("=")) | (fingerprint == "")


def hashes_of(fingerprint: Column) -> Column:
    """The sketch's hashes as an array of 16-digit strings."""
    digits = F.ltrim(fingerprint, F.lit("="))
    n = F.length(digits) / 16
    return F.when(F.length(digits) == 0, F.array().cast("array<string>")).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.greatest(n.cast("int") - 1, F.lit(0))),
            lambda i: F.substring(digits, i * 16 + 1, F.lit(16)),
        )
    )


def containment(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """Share of ``a``'s shingles that ``b`` has: exact between whole sketches, else estimated.

    Estimates use hashes below the threshold; null (unknown) where ``a`` has
    none, and for an empty ``a``. ``probe`` is exact for a whole ``a``.
    """
    x, y, bound = hashes_of(a), hashes_of(b), F.lit(_bound(fraction))
    x = F.when(is_whole(a) & is_whole(b), x).otherwise(F.filter(x, lambda h: h < bound))
    return F.size(F.array_intersect(x, y)) / F.nullif(F.size(x), F.lit(0))


def probe(fingerprint: Column, text: Column, shingle: int = SHINGLE) -> Column:
    """Share of a whole sketch's shingles that a whole text holds, exactly; null for other or empty sketches."""

    @F.arrow_udf("double")
    def share(fingerprints: pa.Array, texts: pa.Array) -> pa.Array:
        out = []
        for f, t in zip(fingerprints.to_pylist(), texts.to_pylist(), strict=True):
            s = from_text(f) if f else None
            if s is None or not s.whole:
                out.append(None)
                continue
            missing = s.hashes
            for hashes in shingle_set(t, shingle):
                missing = np.setdiff1d(missing, hashes, assume_unique=False)
            out.append(1 - len(missing) / len(s.hashes))
        return pa.array(out, pa.float64())

    return share(fingerprint, text)


def containment_of_pairs(
    pairs: DataFrame,
    docs: DataFrame,
    inner: str = "inner_id",
    outer: str = "outer_id",
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    fraction: float = FRACTION,
) -> DataFrame:
    """``(inner_id, outer_id, containment, exact)``: how much of the inner document the outer one holds.

    For given pairs of ids. An inner text of at most ``WHOLE`` distinct
    shingles is probed in the outer one's whole text, any other is estimated
    from the sketches. Null ids have no pairs; repeated ids one row each.
    """
    p = pick(pairs, inner_id=inner, outer_id=outer)
    d = pick(docs, doc_id=id_col, text=text_col)
    sketches = document_sketches(d, shingle=shingle, fraction=fraction)
    inside = sketches.select(F.col("doc_id").alias("inner_id"), F.col("fingerprint").alias("_inner"))
    fingerprint = F.col("_outer")
    around = d.select(F.col("doc_id").alias("outer_id"), "text")
    outlines = sketches.select(F.col("doc_id").alias("outer_id"), F.col("fingerprint").alias("_outer"))
    held = p.join(inside, "inner_id")
    small, large = held.where(is_whole(F.col("_inner"))), held.where(~is_whole(F.col("_inner")))
    exact = small.join(around, "outer_id").select("inner_id", "outer_id", probe(F.col("_inner"), F.col("text"), shingle).alias("containment"), F.lit(True).alias("exact"))
    estimated = large.join(outlines, "outer_id").select("inner_id", "outer_id", containment(F.col("_inner"), fingerprint, fraction).alias("containment"), F.lit(False).alias("exact"))
    return exact.unionByName(estimated)


def merge_sketches(
    sketches: DataFrame, keys: list[str], fingerprint: str = "fingerprint", fraction: float = FRACTION
) -> DataFrame:
    """Sketch of the union of the documents of each group, from their sketches.

    Distinct hashes of a group are reduced before the shuffle. Null
    fingerprints add nothing; a group of empty sketches has an empty one.
    """
    f = F.col(fingerprint)
    rows = (
        sketches.select(*keys, F.coalesce(is_whole(f), F.lit(True)).alias("_whole"), F.explode_outer(hashes_of(f)).alias("_h"))
        .groupBy(*keys, "_h")
        .agg(F.bool_and("_whole").alias("_whole"))
    )
    every = F.array_sort(F.collect_list("_h"))
    whole = F.col("_whole") & (F.size("_all") <= WHOLE)
    kept = F.filter("_all", lambda h: h < F.lit(_bound(fraction)))
    text = F.when(whole & (F.size("_all") > 0), F.concat(F.lit("="), F.array_join("_all", ""))).otherwise(F.array_join(kept, ""))
    merged = rows.groupBy(*keys).agg(every.alias("_all"), F.bool_and("_whole").alias("_whole"))
    return merged.select(*keys, text.alias(fingerprint))


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by the start of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _place(i, head: str | None) -> tuple:
    """Where a row stands: null ids first, then by id, then by the text's first characters."""
    return (False, "", head) if i is None else (True, i, head)


def _pieces(rows: DataFrame, count: int) -> list[tuple]:
    """The first place of each of up to ``count`` consecutive ranges, ascending.

    ``rows`` has ``doc_id, head``. Spark's own range partitioning finds the
    ranges, so many rows of one id (or of none) are cut between texts; the
    driver gets one place for each.
    """
    ranged = rows.repartitionByRange(count, "doc_id", "head")
    found = ranged.groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("doc_id", "head")).alias("least"))
    return sorted(_place(*r["least"]) for r in found.select("least").distinct().collect())


def edited_pairs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    fraction: float = FRACTION,
    pieces: int | None = None,
) -> DataFrame:
    """Fingerprint of every whole text, of its edited text, and their likeness.

    The edited text has its last ``floor(n/2)`` code points replaced by the
    first as many (or all) of the next document's. Documents follow each other
    by id, then text; the last is followed by the first, and a single
    document by itself. Null texts count as empty, null ids come first, rows
    with equal id and text are documents of their own. Columns: ``doc_id,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next``. Likeness is the sketches' (null if unknown, which takes two
    texts without a hash below the threshold, one of more than ``WHOLE`` shingles).

    The table is dealt into consecutive id ranges; the first document of each
    range is also sent to the range before it, as the follower of its last
    one. So whole texts are shuffled once, and each range streams through one
    task in order without being held.
    """
    spark = docs.sparkSession
    d = pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    starts = _pieces(d.select("doc_id", F.left("text", F.lit(_HEAD)).alias("head")), pieces or parts * PIECES_PER_PARTITION)
    id_type = sql_type(d, "doc_id")

    @F.arrow_udf("int")
    def piece_of(ids: pa.Array, heads: pa.Array) -> pa.Array:
        places = map(_place, ids.to_pylist(), heads.to_pylist())
        return pa.array([max(0, bisect_right(starts, p) - 1) for p in places], pa.int32())

    @F.arrow_udf("boolean")
    def starts_piece(ids: pa.Array, heads: pa.Array) -> pa.Array:
        return pa.array([p in firsts for p in map(_place, ids.to_pylist(), heads.to_pylist())], pa.bool_())

    # Heads of the ranges: the first document of each, and of the whole table, by (id, text).
    firsts = set(starts)
    head = F.left("text", F.lit(_HEAD))
    dealt = d.withColumn("piece", piece_of("doc_id", head))
    heads = (
        dealt.where(starts_piece("doc_id", head))
        .groupBy("piece")
        .agg(F.min(F.struct("doc_id", "text")).alias("first"))
        .select(
            "first.*",
            F.when(F.col("piece") == 0, max(len(starts) - 1, 0)).otherwise(F.col("piece") - 1).alias("piece"),
            F.lit(True).alias("follower"),
        )
    )
    rows = dealt.withColumn("follower", F.lit(False)).unionByName(heads.select("doc_id", "text", "piece", "follower"))
    ordered = rows.repartition(parts, "piece").sortWithinPartitions("piece", "follower", "doc_id", "text")

    def finish(now: tuple, nxt: tuple) -> tuple:
        (i, text, s), (_, next_text, next_s) = now, nxt
        changed = edited(text, next_text)
        e = sketch(changed, shingle, fraction)
        digest = hashlib.sha256(changed.encode("utf-8")).hexdigest()
        return i, len(text), digest, to_text(s), to_text(e), likeness(s, e, fraction), likeness(s, next_s, fraction)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, piece = None, None
        for b in slices(batches, 256):
            out = []
            ids, texts, at = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()
            follows = b.column(3).to_pylist()
            for i, t, p, follower in zip(ids, texts, at, follows, strict=True):
                new = (i, t, sketch(t, shingle, fraction))
                if held is not None and p == piece:
                    out.append(finish(held, new))
                held, piece = (None if follower else new), p
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), fields, strict=True)], schema=fields
                )

    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    id_field = pa.field("doc_id", _arrow_type(d))
    fields = pa.schema([id_field, *[pa.field(n, k) for n, k in zip(names, kinds, strict=True)]])
    return ordered.select("doc_id", "text", "piece", "follower").mapInArrow(
        run,
        f"doc_id {id_type}, n_chars bigint, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double",
    )


def _arrow_type(d: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(d.schema["doc_id"].dataType)
