"""SimHash near-duplicates by covering locality-sensitive hashing.

For a radius r, bit i of a 64-bit fingerprint gets a vector a(i) of r+1 bits
that is not zero, and table v (each non-zero vector of r+1 bits) keeps the bits
with odd ``popcount(a(i) & v)``. The at most r bits in which two linked
fingerprints differ span at most r dimensions, so some v is orthogonal to all
of them: that table's mask touches none of the differing bits and both
fingerprints share its key (covering LSH, Pagh 2016). No pair is missed, and
r = 2 needs 7 tables.

Copies collapse to one fingerprint before any table is built. A bucket of at
most ``small_bucket`` fingerprints is compared pair by pair. A larger one (a
big family of near copies) is linked through stars instead of pairs: every
member visits the points at most h = r // 2 free bits away (odd r: h + 1 away,
too), and all visitors of a point link to the smallest one that is within h.
Members of a star are within r of its centre, and two members within r meet at
a point half-way, so components are exact and the work is linear.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.llm.common import pick, restore, slices, sql_type, stage, with_keys
from tablelens.llm.graph import connected_components

BITS = 64
SEED = 42
_CHUNK = 1 << 15  # shingles that are hashed at a time
#: Largest bucket that is compared pair by pair; larger ones use stars.
SMALL_BUCKET = 32


def shingle_hashes(joined: bytes, size: int, seed: int = 0) -> Iterator[np.ndarray]:
    """XXH64 of each ``size``-word shingle of space-joined words, a chunk at a time.

    Fewer words than ``size`` are one shingle; no words have none.
    """
    if not joined:
        return
    gaps = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32)
    count = max(1, len(gaps) + 2 - size)
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    for at in range(0, count, _CHUNK):
        many = min(_CHUNK, count - at)
        starts = [0] * (at == 0) + (gaps[max(at - 1, 0) : at - 1 + many] + 1).tolist()
        ends = gaps[at + size - 1 : at + size - 1 + many].tolist()
        ends += [len(joined)] * (many - len(ends))  # the last shingle ends with the text
        yield np.fromiter((digest(view[s:e], seed) for s, e in zip(starts, ends, strict=True)), np.uint64, many)


def simhash(text: str | None, shingle: int = 3) -> int:
    """Signed 64-bit SimHash of ``text``; 0 for a text without words (or null).

    ``bytes.lower`` maps A-Z only and ``bytes.split`` cuts at the bytes
    0x09-0x0D and 0x20, which is the contract's word rule.
    """
    joined = b" ".join((text or "").encode("utf-8").lower().split())
    ones, total = np.zeros(BITS, dtype=np.int64), 0
    for hashes in shingle_hashes(joined, shingle, SEED):
        rows = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(rows, axis=1).sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int.from_bytes(np.packbits(ones * 2 > total).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(doc_id, doc_key, fp)``: one signed 64-bit SimHash per row, whole texts.

    ``doc_key`` is a hash of the text.
    """
    d = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    names = ["doc_id", "doc_key", "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = pa.array((simhash(t, shingle) for t in b.column(1).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), fp], names)

    return d.mapInArrow(run, f"doc_id {sql_type(d, 'doc_id')}, doc_key bigint, fp bigint")


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """The 2^(radius+1) - 1 unsigned masks; every set of ``radius`` bits is missed by one."""
    vectors = (1 << (radius + 1)) - 1
    owner = [1 + i % vectors for i in range(bits)]
    return [
        sum(1 << i for i in range(bits) if (owner[i] & v).bit_count() % 2) for v in range(1, vectors + 1)
    ]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def hex16(fp: Column) -> Column:
    """16 lowercase hex digits of a signed 64-bit column."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def links(fps: DataFrame, radius: int = 2, small_bucket: int = SMALL_BUCKET) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints (column ``fp``).

    Their connected components are those of "at most ``radius`` differing
    bits", and each edge is such a pair.
    """
    masks = covering_masks(radius)
    tables = F.array(
        *[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks)]
    )
    keyed = fps.select("fp", F.explode(tables).alias("k")).select("fp", "k.t", "k.key")
    buckets = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").hint("rebalance")
    members = stage(keyed.join(buckets, ["t", "key"]), "buckets")
    small = members.where(F.col("n") <= small_bucket).select("t", "key", "fp")
    other = small.withColumnRenamed("fp", "fp2")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= radius
    pairs = small.join(other, ["t", "key"]).where((F.col("fp") < F.col("fp2")) & near)
    stars = _star_links(members.where(F.col("n") > small_bucket), masks, radius)
    return pairs.select(F.col("fp2").alias("a"), F.col("fp").alias("b")).unionByName(stars)


def _star_links(members: DataFrame, masks: list[int], radius: int) -> DataFrame:
    """Links inside large buckets through the points that members visit."""
    h = radius // 2
    reach = range(h + 1 + radius % 2)

    def steps(t: int, mask: int) -> list[tuple[int, int, bool]]:
        free = [i for i in range(BITS) if not mask >> i & 1]
        return [
            (t, _signed(sum(1 << i for i in some)), k <= h) for k in reach for some in combinations(free, k)
        ]

    rows = [r for t, m in enumerate(masks) for r in steps(t, m)]
    moves = members.sparkSession.createDataFrame(rows, "t int, flip bigint, inner boolean")
    # One row per table and set of free bits: fixed by the radius, not by the data.
    visits = members.join(F.broadcast(moves), "t").select(
        "t", "fp", "inner", F.col("fp").bitwiseXOR(F.col("flip")).alias("point")
    )
    centres = (
        visits.where("inner")
        .groupBy("t", "point")
        .agg(F.min("fp").alias("centre"), F.count(F.lit(1)).alias("n"))
    )
    if radius % 2 == 0:
        centres = centres.where("n > 1")
    centres = centres.drop("n").hint("rebalance")
    return (
        visits.join(centres, ["t", "point"])
        .where("fp != centre")
        .select(F.col("fp").alias("a"), F.col("centre").alias("b"))
        .distinct()
    )


def _labelled(docs: DataFrame, id_col: str, text_col: str, shingle: int, radius: int, small_bucket: int) -> DataFrame:
    """``(doc_id, doc_key, fp, component, component_id)``; ``component`` is a fingerprint."""
    fps = stage(fingerprints(docs, id_col, text_col, shingle), "simhash")
    classes = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("root")), "simhash-classes")
    parts = connected_components(links(classes.select("fp"), radius, small_bucket))
    member = classes.join(parts, classes["fp"] == parts["node"], "left").select(
        "fp", "root", F.coalesce("component", "fp").alias("component")
    )
    roots = member.groupBy("component").agg(F.min("root").alias("component_id")).hint("rebalance")
    named = stage(member.join(roots, "component").select("fp", "component", "component_id"), "simhash-roots")
    # Both sides are plain scans, so AQE may split the partition of a hot fingerprint.
    return fps.join(named, "fp")


def simhash_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    max_distance: int = 2,
    small_bucket: int = SMALL_BUCKET,
) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per input row.

    ``component_id`` is the smallest id among all documents that chains of
    links (at most ``max_distance`` differing bits) reach, itself included.
    Null texts count as empty; texts without words have fingerprint zero and
    link like any other. Rows with a repeated id are documents of their own
    with the same id. Null ids never become a component's id unless all of
    its ids are null. An empty table gives an empty result.
    """
    found = _labelled(docs, id_col, text_col, shingle, max_distance, small_bucket)
    return found.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one_per_component(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    max_distance: int = 2,
    small_bucket: int = SMALL_BUCKET,
) -> DataFrame:
    """The row of each component that has the smallest id, all columns as they were.

    Of several rows of a component that share the smallest id, the one with
    the smallest text hash stays; of rows that share both, any one.
    """
    found = _labelled(docs, id_col, text_col, shingle, max_distance, small_bucket)
    first = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = stage(
        first.groupBy("component").agg(
            F.min("doc_key").alias("_key"), F.first("doc_id").alias("_kept"), F.count(F.lit(1)).alias("_n")
        ),
        "simhash-kept",
    )
    plain, private = with_keys(docs, _id=id_col, _text=text_col)
    keyed = plain.withColumn("_doc_key", F.xxhash64(F.coalesce("_text", F.lit(""))))
    same = F.col("_id").eqNullSafe(F.col("_kept")) & (F.col("_doc_key") == F.col("_key"))
    rows = keyed.join(kept.select("_kept", "_key"), same, "left_semi")
    if not kept.where("_n > 1").isEmpty():  # ids repeat: rows with equal id and text are left
        rows = rows.dropDuplicates(["_id", "_doc_key"])
    return restore(rows, private, docs)
