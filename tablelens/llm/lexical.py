"""Ranked lexical search by dense blocked matrix products.

Items (the stated query set) go in blocks of bounded size against all
documents. A block's vocabulary is shipped to the tasks; one scan counts its
terms in every whole text, document frequencies are a grouped sum, and a second
scan, over the counts alone, multiplies tiles: (items x terms) weights times
(terms x documents) impacts, both dense float64 and compacted to the terms that
the tiles have. Weights and impacts are whole numbers; a product sums at most
``VOCAB_TILE`` of them, which stays below 2^53, so each partial sum is exact in
whatever order BLAS adds, and partial sums add up as 64-bit integers.

A tile keeps its ``k`` best documents of each item with equal scores by
ascending id, so no tie is lost; tasks merge their tiles, and a window merges
the tasks.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablelens.llm.common import pick, slices, sql_type, stage

#: Items of a block, and its item-term pairs and term bytes, from which on a new block begins.
BLOCK_ITEMS, BLOCK_TERMS, BLOCK_BYTES = 1024, 1 << 16, 1 << 24
#: Sides of the tiles: items, item-term pairs, documents, terms.
ITEM_TILE, ITEM_TILE_TERMS, DOC_TILE, VOCAB_TILE = 256, 1 << 14, 256, 4096
_PIECE = 1 << 22

# ASCII letters in lower case, digits and the bytes of other code points stay; the rest parts terms.
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def term_pieces(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a whole text in order, a bounded piece at a time."""
    raw = (text or "").encode("utf-8").translate(_TABLE)
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + _PIECE)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


@dataclass
class Block:
    """Items with their distinct terms as numbers of the block's vocabulary."""

    vocabulary: dict[bytes, int]
    ids: list
    terms: list[list[int]]


def item_blocks(items: DataFrame) -> Iterator[Block]:
    """Blocks of the query set (columns ``item_id, text``), read one partition at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            terms = [sorted({t for piece in term_pieces(x) for t in piece}) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(terms, pa.list_(pa.binary()))], ["item_id", "terms"])

    block, pairs, held = Block({}, [], []), 0, 0
    distinct = items.mapInArrow(run, f"item_id {sql_type(items, 'item_id')}, terms array<binary>")
    for item_id, terms in distinct.toLocalIterator():
        if not terms:
            continue
        size = sum(map(len, terms))
        full = len(block.ids) >= BLOCK_ITEMS or pairs + len(terms) > BLOCK_TERMS or held + size > BLOCK_BYTES
        if block.ids and full:
            yield block
            block, pairs, held = Block({}, [], []), 0, 0
        numbers = block.vocabulary
        block.ids.append(item_id)
        block.terms.append([numbers.setdefault(bytes(t), len(numbers)) for t in terms])
        pairs, held = pairs + len(terms), held + size
    if block.ids:
        yield block


def _counted(docs: DataFrame, block: Block) -> DataFrame:
    """``(doc_id, n, terms, tf)``: terms of each whole text, and how often it has the block's."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(block.vocabulary)  # bounded by item_blocks
    names = ["doc_id", "n", "terms", "tf"]
    lists = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value.get
        for b in slices(batches):
            sizes, terms, tfs = [], [], []
            for text in b.column(1).to_pylist():
                n, found = 0, Counter()
                for piece in term_pieces(text):
                    n += len(piece)
                    found.update(map(number, piece))
                found.pop(None, None)
                sizes.append(n)
                terms.append(list(found.keys()))
                tfs.append(list(found.values()))
            arrays = [b.column(0), pa.array(sizes, pa.int64()), pa.array(terms, lists), pa.array(tfs, lists)]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.mapInArrow(run, f"doc_id {sql_type(docs, 'doc_id')}, n bigint, terms array<int>, tf array<int>")


def term_weights(frequency: np.ndarray, documents: int) -> np.ndarray:
    """floor(1000 ln((2N + 2) / (2 df + 1))) of each document frequency."""
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in frequency], np.float64)


def _item_tiles(block: Block, weights: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """``(first item, its terms ascending, items x terms weights)`` of each item tile."""
    tiles, at = [], 0
    while at < len(block.ids):
        end, pairs = at + 1, len(block.terms[at])
        while end < len(block.ids) and end - at < ITEM_TILE and pairs + len(block.terms[end]) <= ITEM_TILE_TERMS:
            pairs += len(block.terms[end])
            end += 1
        own = np.unique(np.concatenate([np.array(t) for t in block.terms[at:end]]))
        dense = np.zeros((end - at, len(own)))
        for row, terms in enumerate(block.terms[at:end]):
            dense[row, np.searchsorted(own, terms)] = weights[terms]
        tiles.append((at, own, dense))
        at = end
    return tiles


def tile_scores(dense: np.ndarray, own: np.ndarray, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, docs: int) -> np.ndarray:
    """Exact 64-bit scores, items x documents, of one item tile and one document tile.

    ``term, doc, impact`` are the document tile's entries; terms outside
    ``own`` count nothing.
    """
    place = np.minimum(np.searchsorted(own, term), len(own) - 1)
    mine = own[place] == term
    place, doc, impact = place[mine], doc[mine], impact[mine]
    present, place = np.unique(place, return_inverse=True)
    total = np.zeros((len(dense), docs), np.int64)
    for s in range(0, len(present), VOCAB_TILE):
        some = (place >= s) & (place < s + VOCAB_TILE)
        tile = np.zeros((min(VOCAB_TILE, len(present) - s), docs))
        tile[place[some] - s, doc[some]] = impact[some]
        total += (dense[:, present[s : s + VOCAB_TILE]] @ tile).astype(np.int64)
    return total


def _order(entry: tuple) -> tuple:
    score, doc_id = entry
    return -score, doc_id is not None, doc_id


class _Best:
    """The ``k`` best ``(score, doc_id)`` of each item seen by a task."""

    def __init__(self, items: int, k: int):
        self.k, self.floor, self.held = k, np.ones(items, np.int64), [[] for _ in range(items)]

    def add(self, first: int, scores: np.ndarray, ids: list) -> None:
        """Scores of a tile whose documents stand in ascending order of id."""
        top = np.argsort(-scores, axis=1, kind="stable")[:, : self.k]
        best = np.take_along_axis(scores, top, axis=1)
        for i, j in zip(*np.nonzero(best >= self.floor[first : first + len(scores), None]), strict=True):
            held = self.held[first + i]
            held.append((int(best[i, j]), ids[top[i, j]]))
            if len(held) >= 4 * self.k:
                self._prune(first + i)

    def _prune(self, item: int) -> list:
        held = self.held[item] = sorted(self.held[item], key=_order)[: self.k]
        if len(held) == self.k:
            self.floor[item] = held[-1][0]
        return held

    def rows(self) -> Iterator[tuple]:
        for item in range(len(self.held)):
            for score, doc_id in self._prune(item):
                yield item, doc_id, score


def _scored(counted: DataFrame, block: Block, weights: np.ndarray, documents: int, length: int, k: int) -> DataFrame:
    """``(item, doc_id, score)``: each task's ``k`` best documents of each item of the block."""
    tiles = counted.sparkSession.sparkContext.broadcast(_item_tiles(block, weights))
    items, id_type = len(block.ids), sql_type(counted, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, kind = _Best(items, k), None
        for b in slices(batches, DOC_TILE):
            kind = b.schema.field(0).type
            ids = b.column(0).to_pylist()
            order = sorted(range(len(ids)), key=lambda i: _order((0, ids[i])))
            turn = np.empty(len(ids), np.int64)
            turn[order] = np.arange(len(ids))
            m = np.array([10 + (90 * n * documents) // length for n in b.column(1).to_pylist()], np.int64)
            term = b.column(2).flatten().to_numpy().astype(np.int64)
            tf = b.column(3).flatten().to_numpy().astype(np.int64)
            doc = np.repeat(np.arange(len(ids)), b.column(2).value_lengths().to_numpy())
            impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
            for first, own, dense in tiles.value:
                best.add(first, tile_scores(dense, own, term, turn[doc], impact, len(ids)), [ids[i] for i in order])
        rows = list(best.rows())
        if rows:
            item, doc_ids, scores = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(item, pa.int32()), pa.array(doc_ids, kind), pa.array(scores, pa.int64())], ["item", "doc_id", "score"]
            )

    return counted.mapInArrow(run, f"item int, doc_id {id_type}, score bigint")


def ranked_search(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    k: int = 10,
) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: each item's ``k`` best documents with a score above 0.

    Terms are runs of ASCII letters (A-Z in lower case), ASCII digits and
    other non-ASCII characters. Ranks count from 1, highest score first, equal
    scores by ascending id (null first). Null and empty texts have no terms:
    such a document never ranks, such an item has no rows. Rows that repeat an
    id are documents, or items, of their own. Empty tables give an empty
    result. Statistics (documents with a term, their terms, frequencies) cover
    every row.
    """
    d = pick(docs, doc_id=id_col, text=text_col)
    queries = pick(items, item_id=item_id_col, text=item_text_col)
    spark, found = d.sparkSession, None
    schema = f"item_id {sql_type(queries, 'item_id')}, rank int, doc_id {sql_type(d, 'doc_id')}, score bigint"
    for block in item_blocks(queries):
        counted = stage(_counted(d, block), "lexical-counts")
        documents, length = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not documents:
            break
        frequency = np.zeros(len(block.vocabulary), np.int64)
        for term, df in counted.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
            frequency[term] = df
        scored = _scored(counted, block, term_weights(frequency, documents), documents, length, k)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc("doc_id"))
        ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(block.ids)), f"item int, item_id {sql_type(queries, 'item_id')}")
        rows = ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        found = rows if found is None else found.unionByName(rows)
    return spark.createDataFrame([], schema) if found is None else found
