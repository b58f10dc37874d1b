"""Cross-tokenizer alignment by divide and conquer at shared cuts.

Two tokenizers cut the same bytes. An interval of tokens is divided at a byte
offset where tokens of both end, the one nearest to its middle that a bisection
finds; both halves are divided in turn, and an interval without such an offset
is a leaf: one group of tokens of A facing tokens of B. All intervals of a
batch take each step together, as arrays.

Offsets before the white space that follows a word are shared cuts of every
text for the tokenizers used here (A's pattern never takes white space after
other characters, no piece of B has a space after another character or a line
feed at all), so texts are divided there first, and a chunk between two such
offsets is encoded and divided once per task however often it occurs.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablelens.llm.common import pick, slices, sql_type, stage

#: Chunks that a Python worker remembers (twice as many at most), and the longest such chunk in characters.
CACHE, CACHED_CHARS = 180_000, 48
#: Id pairs up to which their counts are broadcast (16 bytes each); more are joined by shuffle.
PAIR_LIMIT = 2_000_000
_B_BITS = 32

_CHUNK = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_CUT = re.compile(r"(?<![ \n])[ \n]")
_OTHER_SPACE = re.compile(r"[^\S \n]")
_PIECE = 1 << 20
#: Chunks that are encoded together: words of long-known letters, without white space at the end.
_PLAIN = re.compile("[ \n]*[!-~\u00a1-\u024f\u0370-\u0373\u0386-\u03ce\u0400-\u0481\u048a-\u0513\u3041-\u3094\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]{1,400}")


def divide(a_ends: np.ndarray, b_ends: np.ndarray, a_cuts: np.ndarray, b_cuts: np.ndarray) -> np.ndarray:
    """Leaf groups, rows ``a0, a1, b0, b1`` in order, of two token sequences over the same bytes.

    ``a_ends`` and ``b_ends`` ascend and have the same last value; ``a_cuts``
    and ``b_cuts`` are the tokens before which known shared cuts lie (the
    last: all tokens). An interval looks up the ends of A in B from its middle
    outwards until one is shared, and hands on which are known not to be, so
    every end is looked up at most once.
    """
    if not len(a_cuts):
        return np.empty((0, 4), np.int64)
    a0, b0 = np.append(0, a_cuts[:-1]), np.append(0, b_cuts[:-1])
    # a0, a1, b0, b1, low, high: no end of A in [low, high) is shared; middles are found below
    todo = np.stack([a0, a_cuts, b0, b_cuts, a0, a0], axis=1)
    fresh, leaves = np.ones(len(todo), bool), []
    while len(todo):
        a0, a1, b0, b1, low, high = todo.T
        begin = np.where(a0 > 0, a_ends[a0 - 1], 0)
        middle = np.clip(np.searchsorted(a_ends, (begin + a_ends[a1 - 1]) // 2), a0, a1 - 1)
        low, high = np.where(fresh, middle, low), np.where(fresh, middle, high)
        below, above = low > a0, high < a1 - 1
        leaf = (a1 - a0 == 1) | (b1 - b0 == 1) | ~(below | above)
        leaves.append(todo[leaf, :4])
        a0, a1, b0, b1, low, high, below, above = (x[~leaf] for x in (a0, a1, b0, b1, low, high, below, above))
        down = below & (~above | ((high - low) % 2 == 0))
        i = np.where(down, low - 1, high)  # the end that is looked up
        j = np.searchsorted(b_ends, a_ends[i])
        shared = b_ends[j] == a_ends[i]
        low, high = np.where(down, i, low), np.where(down, high, i + 1)
        on = np.stack([a0, a1, b0, b1, low, high], axis=1)[~shared]
        # Halves at a shared end; where it lies beside the known zone, one of them has the zone to itself.
        a0, a1, b0, b1, low, high, i, j, down = (x[shared] for x in (a0, a1, b0, b1, low, high, i, j, down))
        left = np.stack([a0, i + 1, b0, j + 1, low, np.where(down, low, i)], axis=1)
        right = np.stack([i + 1, a1, j + 1, b1, i + 1, np.where(down, high, i + 1)], axis=1)
        todo = np.concatenate([on, left, right])
        fresh = todo[:, 4] >= todo[:, 5]
    found = np.concatenate(leaves)
    return found[np.argsort(found[:, 0])]


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token pairs whose byte ranges overlap, in order, and where their overlap ends: one for each end of either."""
    ends = np.union1d(a_ends, b_ends)
    return np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends), ends


class TokenPair:
    """Both tokenizers, and the alignments of chunks met before.

    A chunk's entry is ``(tokens of A, tokens of B, groups, group text, links)``
    with the links as little-endian 64-bit ``a << 32 | b``, or None where the
    tokens' bytes are not the text's.
    """

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self._a = Tokenizer.from_file(a_path)
        self._a.encode_special_tokens = True
        self._b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        # Byte-level BPE writes printable bytes as themselves and the others as U+0100 onwards.
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [x for x in range(256) if x not in printable]
        byte_of = {chr(x): x for x in printable} | {chr(0x100 + n): x for n, x in enumerate(others)}
        with open(a_path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        raw = {bytes(byte_of[c] for c in t): i for t, i in vocabulary.items() if all(c in byte_of for c in t)}
        # A's merges are ranked by id: the same BPE, some six times as fast on many words at once.
        self._words = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=raw, special_tokens={})
        self._a_bytes = [t.encode("utf-8") for t, _ in sorted(self._a.get_vocab(with_added_tokens=True).items(), key=lambda x: x[1])]
        for t, i in raw.items():
            self._a_bytes[i] = t
        pieces = [self._b.id_to_piece(i) for i in range(self._b.get_piece_size())]
        self._b_bytes = [
            bytes([int(p[3:5], 16)]) if self._b.is_byte(i) else p.replace("▁", " ").encode("utf-8")
            for i, p in enumerate(pieces)
        ]
        self._a_sizes, self._b_sizes = (np.array([len(x) for x in t]) for t in (self._a_bytes, self._b_bytes))
        # Decimal ids with what follows them: A's "," and "|", B's "," and ";".
        self._text = [b"%d%s" % (i, mark) for t, marks in ((self._a_bytes, (b",", b"|")), (self._b_bytes, (b",", b";"))) for mark in marks for i in range(len(t))]
        self._space = self._b.piece_to_id("▁")
        if any(re.search("[^▁]▁|\n", p) for p in pieces):
            raise ValueError("pieces cross the white space at which texts are cut")
        self._new: dict[str, tuple | None] = {}
        self._old: dict[str, tuple | None] = {}

    def _encode(self, text: str, words: bool) -> tuple[list[int], list[int]]:
        a = self._words.encode_ordinary(text) if words else self._a.encode(text, add_special_tokens=False).ids
        # B puts a space before what it is given: the text's own, or one that is taken off again.
        if text == " ":  # nothing else is left, and B gives nothing for it
            return a, [self._space]
        b = self._b.encode(text[1:] if text[0] == " " else text)
        return a, b if text[0] == " " else b[1:]

    def _fresh(self, chunks: list[str], words: bool) -> list[tuple | None]:
        """Entries of chunks that are encoded as one text."""
        text = "".join(chunks)
        a, b = self._encode(text, words)
        raw = text.encode("utf-8")
        if b"".join([self._a_bytes[i] for i in a]) != raw or b"".join([self._b_bytes[i] for i in b]) != raw:
            return [None] if len(chunks) == 1 else [e for c in chunks for e in self._fresh([c], words)]
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        a_ends, b_ends = np.cumsum(self._a_sizes[a]), np.cumsum(self._b_sizes[b])
        stops = np.cumsum([len(c.encode("utf-8")) for c in chunks])
        a_cuts, b_cuts = np.searchsorted(a_ends, stops) + 1, np.searchsorted(b_ends, stops) + 1
        leaves = divide(a_ends, b_ends, a_cuts, b_cuts)
        groups = np.searchsorted(leaves[:, 1], a_cuts) + 1
        i, j, ends = overlaps(a_ends, b_ends)
        links = (a[i] << _B_BITS | b[j]).astype("<i8").tobytes()
        link_stops = 8 * (np.searchsorted(ends, stops) + 1)
        # Tokens in the order of the group text: a leaf's tokens of A, then those of B.
        a0, a1, b0, b1 = leaves.T
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.repeat(b0, a1 - a0)] = a
        order[np.arange(len(b)) + np.repeat(a1, b1 - b0)] = b + 2 * len(self._a_sizes)
        order[a1 - 1 + b0] += len(self._a_sizes)
        order[b1 - 1 + a1] += len(self._b_sizes)
        texts, text_stops = [self._text[k] for k in order.tolist()], a_cuts + b_cuts

        def parts(stops: np.ndarray) -> Iterator[tuple[int, int]]:
            return zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)

        return [
            (e - s, f - t, h - g, b"".join(texts[u:v])[:-1], links[x:y])
            for (s, e), (t, f), (g, h), (u, v), (x, y) in zip(
                *map(parts, (a_cuts, b_cuts, groups, text_stops, link_stops)), strict=True
            )
        ]

    def _entries(self, chunks: set[str]) -> dict[str, tuple | None]:
        """Entries of all ``chunks``; of those that were not remembered, words are encoded together."""
        new, old = self._new, self._old
        known = {c: new[c] for c in chunks & new.keys()}
        fresh = chunks - known.keys()
        found = {c: old[c] for c in fresh & old.keys()}
        fresh -= found.keys()
        words = [c for c in fresh if _PLAIN.fullmatch(c)]
        if words:
            found.update(zip(words, self._fresh(words, True), strict=True))
        for c in fresh.difference(words):
            found[c] = self._fresh([c], False)[0]
        if len(new) + len(found) > CACHE:
            self._old, self._new = new, {}
        self._new.update((c, e) for c, e in found.items() if len(c) <= CACHED_CHARS)
        known.update(found)
        return known

    def align(self, texts: list[str | None]) -> Iterator[tuple[list[tuple], bool]]:
        """For each text the entries of its chunks in order, and whether its bytes survive both tokenizers."""
        waiting = [list(chunk_lists(text)) for text in texts]
        known = self._entries({c for pieces in waiting for piece in pieces for c in piece})
        for pieces in waiting:
            entries = [known[c] for piece in pieces for c in piece]
            whole = bool(entries) and None not in entries
            yield entries if whole else [], whole


def chunk_lists(text: str | None) -> Iterator[list[str]]:
    """The chunks of space + text, a bounded piece at a time; none for a null or empty text.

    A text with white space other than spaces and line feeds is one chunk:
    both tokenizers see it whole.
    """
    if not text:
        return
    text = " " + text
    if _OTHER_SPACE.search(text):
        yield [text]
        return
    at = 0
    while at < len(text):
        cut = _CUT.search(text, at + _PIECE)
        end = cut.start() if cut else len(text)
        yield _CHUNK.findall(text, at, end)
        at = end


@functools.cache
def token_pair(a_path: str, b_path: str) -> TokenPair:
    """One pair for each Python worker, so its memory outlives a task."""
    return TokenPair(a_path, b_path)


def aligned_tokens(
    docs: DataFrame,
    tokenizers: Callable[[], TokenPair],
    id_col: str = "doc_id",
    text_col: str = "text",
    hashed: bool = False,
) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, groups, links)``, one row per document.

    ``tokenizers`` makes the pair inside a task. ``groups`` is
    ``a1,a2|b1;a3|b2,b3``: ids of A and B that face each other, in order
    (``hashed``: its SHA-256 in lower-case hex); ``links`` holds every pair of
    overlapping tokens as ``a << 32 | b``.

    Null and empty texts, and texts whose bytes a tokenizer changes, have no
    tokens: zeros, an empty string and no links. Null and repeated ids are
    documents like others; an empty table gives an empty result.
    """
    d = pick(docs, doc_id=id_col, text=text_col)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = tokenizers()
        for b in slices(batches, 256):
            counts, groups, links = [], [], []
            for entries, whole in pair.align(b.column(1).to_pylist()):
                n_a, n_b, n_groups, texts, own = zip(*entries, strict=True) if whole else ((),) * 5
                links.append(b"".join(own))
                counts.append((sum(n_a), sum(n_b), sum(n_groups), len(links[-1]) // 8))
                text = b";".join(texts)
                groups.append((hashlib.sha256(text).hexdigest() if hashed and text else text.decode("ascii")))
            offsets = np.concatenate([[0], np.cumsum([c[3] for c in counts])]).astype(np.int32)
            flat = pa.array(np.frombuffer(b"".join(links), "<i8"))
            numbers = [pa.array(c, pa.int64()) for c in zip(*counts, strict=True)] if counts else [pa.array([], pa.int64())] * 4
            arrays = [b.column(0), *numbers, pa.array(groups, pa.string()), pa.ListArray.from_arrays(pa.array(offsets), flat)]
            yield pa.RecordBatch.from_arrays(arrays, names)

    kinds = ", ".join(f"{n} bigint" for n in names[1:5])
    return d.mapInArrow(run, f"doc_id {sql_type(d, 'doc_id')}, {kinds}, groups string, links array<bigint>")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``(link, count, best)``: links of each id pair in the corpus; best: no pair of its B id has more."""
    counts = aligned.select(F.explode("links").alias("link")).groupBy("link").agg(F.count(F.lit(1)).alias("count"))
    b = F.col("link").bitwiseAND(F.lit((1 << _B_BITS) - 1))
    top = F.max("count").over(Window.partitionBy(b))
    return counts.withColumn("best", F.col("count") == top)


def link_support(
    docs: DataFrame,
    tokenizers: Callable[[], TokenPair],
    id_col: str = "doc_id",
    text_col: str = "text",
    pair_limit: int = PAIR_LIMIT,
) -> DataFrame:
    """``aligned_tokens`` with ``n_best`` and ``count_sum`` instead of the links, groups hashed.

    A pair's count is its number of links in all documents. ``n_best`` are a
    document's links whose count is the highest of their B id (ties included),
    ``count_sum`` adds the counts of all its links; both are 0 without links.
    """
    found = aligned_tokens(docs, tokenizers, id_col, text_col, hashed=True)
    aligned = stage(found.withColumn("row", F.monotonically_increasing_id()), "alignments")
    pairs = stage(pair_counts(aligned), "pair-counts")
    side = F.broadcast(pairs) if pairs.count() <= pair_limit else pairs
    links = aligned.select("row", F.explode("links").alias("link"))
    sums = (
        links.join(side, "link")
        .groupBy("row")
        .agg(F.count_if("best").alias("n_best"), F.sum("count").alias("count_sum"))
    )
    none = F.lit(0).cast("bigint")
    return aligned.join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        F.coalesce("n_best", none).alias("n_best"),
        F.coalesce("count_sum", none).alias("count_sum"),
        F.col("groups").alias("groups_sha256"),
    )
