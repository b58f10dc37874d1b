"""Packing token sequences by Karmarkar-Karp multiway differencing.

Every document is tokenised once. Its whole windows (``capacity`` tokens each)
need no packing; what is left, cut into pieces of at most ``piece`` tokens, is
dealt into windows block by block. In a block of bounded size the differencing
method starts with one partial partition per piece (one window holds it, the
others are empty), always merges the two partial partitions with the largest
imbalance, the fullest window of one with the emptiest of the other, and ends
with near-equal windows. If one exceeds the capacity, the block is dealt again
into more windows.

Blocks are filled in the task that tokenises the documents: tokens are never
shuffled, a task holds one block of piece lengths, and a lost task repeats
alone with the same result, since a window's id is made of the input partition
and the window's number there.
"""

from __future__ import annotations

import functools
import heapq
import struct
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tablelens.llm.common import pick, slices, sql_type, text_pieces

CAPACITY = 2048
#: Longest piece of a document's last, partial window.
PIECE = 512
#: Piece lengths that are packed together.
BLOCK = 1024
#: Chunks whose ids a Python worker remembers (twice as many at most), and the longest such chunk.
CACHE, CACHED_BYTES = 600_000, 48
_PART_SHIFT = 33


def differencing(lengths: list[int], windows: int) -> np.ndarray:
    """Window (0..windows-1) of each piece by multiway Karmarkar-Karp.

    A partial partition is the sorted vector of its windows' sums above the
    smallest one; its imbalance is the largest entry. Pieces of a window form
    a linked list, so a merge is a handful of vector operations.
    """
    n = len(lengths)
    nxt, last = np.full(n, -1), np.arange(n)
    heap = []
    for i, length in enumerate(lengths):
        sums, heads = np.zeros(windows, dtype=np.int64), np.full(windows, -1)
        sums[-1], heads[-1] = length, i
        heap.append((-int(length) if windows > 1 else 0, i, sums, heads))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, order, a, ha = heapq.heappop(heap)
        _, _, b, hb = heapq.heappop(heap)
        b, hb = b[::-1], hb[::-1]  # the fullest of one meets the emptiest of the other
        both = (ha >= 0) & (hb >= 0)
        nxt[last[ha[both]]] = hb[both]
        last[ha[both]] = last[hb[both]]
        sums, heads = a + b, np.where(ha >= 0, ha, hb)
        rank = np.argsort(sums, kind="stable")
        sums, heads = sums[rank], heads[rank]
        heapq.heappush(heap, (-int(sums[-1] - sums[0]), order, sums - sums[0], heads))
    window = np.empty(n, dtype=np.int64)
    for w, i in enumerate(heap[0][3] if heap else ()):
        while i >= 0:
            window[i] = w
            i = nxt[i]
    return window


def pack_block(lengths: list[int], capacity: int = CAPACITY) -> np.ndarray:
    """Window of each piece (all of 1 to ``capacity`` tokens), none over capacity."""
    windows = max(1, -(-sum(lengths) // capacity))
    while True:
        window = differencing(lengths, windows)
        if np.bincount(window, weights=lengths, minlength=windows).max(initial=0) <= capacity:
            return window
        windows += max(1, windows // 256)


class WordTokenizer(dict):
    """Ids of whole texts (little-endian 32-bit), remembering those of chunks.

    For a BPE tokenizer that folds case, drops white space and never joins
    letters with other characters: the ids of a text are those of its chunks
    between ASCII white space, and a full stop or comma at a chunk's end, after
    a letter, has an id of its own. A chunk of letters goes straight to the tokenizer's
    BPE model; every other chunk, and a whole text that might hold a special
    token, goes through the complete tokenizer.
    """

    def __init__(self, path: str):
        super().__init__()
        self._older: dict[bytes, bytes] = {}
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self._special = [t.content.lower() for t in self._tokenizer.get_added_tokens_decoder().values()]
        # Byte-level BPE writes printable bytes as themselves and the others as U+0100 onwards.
        printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        others = iter(range(0x100, 0x200))
        self._symbols = {x: x if x in printable else next(others) for x in range(256)}

    def _whole(self, text: str) -> bytes:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, chunk: bytes) -> bytes:
        if (ids := self._older.get(chunk)) is not None:
            return self._remember(chunk, ids)
        if len(chunk) > CACHED_BYTES:
            return self._whole(chunk.decode("utf-8"))
        if chunk.isalpha():  # ASCII letters alone: byte-level BPE writes them as themselves
            ids = self._letters(chunk.decode("ascii"))
        elif chunk.endswith((b".", b",")) and chunk[-2:-1].isalpha():
            ids = self[chunk[:-1]] + self[chunk[-1:]]
        else:
            text = chunk.decode("utf-8")
            if text.isalpha() and text.islower() and unicodedata.is_normalized("NFC", text):
                ids = self._letters(chunk.decode("latin-1").translate(self._symbols))
            else:
                ids = self._whole(text)
        return self._remember(chunk, ids)

    def _letters(self, symbols: str) -> bytes:
        tokens = self._model.tokenize(symbols)
        return struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])

    def _remember(self, chunk: bytes, ids: bytes) -> bytes:
        """Keep ``ids``; a full memory becomes the older half, which is looked up once more."""
        if len(self) >= CACHE:
            self._older = dict(self)
            self.clear()
        self[chunk] = ids
        return ids

    def __call__(self, text: str) -> np.ndarray:
        folded = text.lower()
        if any(s in folded for s in self._special):
            ids = self._whole(text)
        else:
            pieces = (p.encode("utf-8").lower().split() for p in text_pieces(text))
            ids = b"".join(b"".join(map(self.__getitem__, chunks)) for chunks in pieces)
        return np.frombuffer(ids, dtype="<u4")


@functools.cache
def word_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for each Python worker, so its memory outlives a task."""
    return WordTokenizer(path)


def pack_documents(
    docs: DataFrame,
    tokenizer: Callable[[], Callable[[str], np.ndarray]],
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = 1,
    piece: int = PIECE,
    block: int = BLOCK,
) -> DataFrame:
    """Pieces of documents in sequences of at most ``capacity`` tokens.

    ``tokenizer`` makes, inside a task, a function from a text to its ids;
    ``end_id`` follows each document's ids. Columns: ``doc_id, start, length,
    ids_crc32, doc_tokens, sequence_id, offset``; each id lies in exactly one
    piece, and a sequence's pieces lie at offsets without gaps from 0.

    A null text counts as empty (its ``end_id`` alone is packed); null and
    repeated ids are packed like others, row by row; an empty table gives no
    sequences.
    """
    d = pick(docs, doc_id=id_col, text=text_col)
    piece = min(piece, capacity)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer()
        base = TaskContext.get().partitionId() << _PART_SHIFT
        made = 0  # sequences so far
        done: list[tuple] = []  # finished pieces
        waiting: list[tuple] = []  # pieces of partial windows

        def emit() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            arrays = [pa.array(columns[0], id_type), *[pa.array(c, pa.int64()) for c in columns[1:]]]
            done.clear()
            return pa.RecordBatch.from_arrays(arrays, names)

        def deal() -> None:
            nonlocal made
            window = pack_block([p[2] for p in waiting], capacity)
            used = np.zeros(window.max() + 1, dtype=np.int64)
            for p, w in zip(waiting, window, strict=True):
                done.append((*p, base + made + int(w), int(used[w])))
                used[w] += p[2]
            made += len(used)
            waiting.clear()

        id_type = pa.null()
        for b in slices(batches):
            id_type = b.schema.field(0).type
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4", copy=False)
                total = len(ids)
                whole = total - total % capacity
                cuts = [*range(0, whole, capacity), *range(whole, total, piece), total]
                for s, e in zip(cuts, cuts[1:], strict=False):
                    p = (i, s, e - s, zlib.crc32(ids[s:e].tobytes()), total)
                    if e - s == capacity:
                        done.append((*p, base + made, 0))
                        made += 1
                    else:
                        waiting.append(p)
                if len(waiting) >= block:
                    deal()
                if len(done) >= 4096:
                    yield emit()
        if waiting:
            deal()
        if done:
            yield emit()

    kinds = f"doc_id {sql_type(d, 'doc_id')}, " + ", ".join(f"{n} bigint" for n in names[1:])
    return d.mapInArrow(run, kinds)
