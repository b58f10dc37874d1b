"""Suffix-array dedup: byte strings of a given width that occur twice, by external induced sorting.

Equal strings must meet in one shard. Every string of ``width`` bytes picks an
anchor: of its ``anchor``-byte substrings the one with the smallest hash
(rightmost of equal ones), so equal strings pick equal anchors at equal
offsets. Neighbouring starts with one anchor form a run; the bytes that its
strings span are its context. Equal contexts are one class with a number of
copies. Only classes whose anchor some other class has, too, can share a string
in part; their contexts are dealt into shards by anchor, and each shard's
suffixes are sorted (``induced``: suffix tuples and common prefixes through
disk-backed queues, so a shard may be larger than memory). Neighbours with
``width`` symbols in common are repeated strings.

An anchor that very many different contexts share (a short passage that a third
of all texts hold) is no single shard: its contexts are cut into runs whose
strings have a longer part in common, keyed by a hash of that part, and go
through the same steps; parts grow until a part is a whole string, of which
equal ones are one class. Nothing is left out by it.

Texts are read where they lie by hash of id and text; nothing but counts passes
through the driver.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.llm.common import pick, slices, sql_type, stage
from tablelens.llm.induced import Files, Writer, sorted_suffixes

WIDTH = 400
#: Bytes of an anchor, contexts of one anchor that go to one shard, bytes of a shard.
ANCHOR, GROUP, SHARD_BYTES = 128, 4096, 4 << 20
#: Tuples that a queue holds, and names that are sorted in memory; bytes of an array that needs no file.
MEMORY, SPARE = 2_000_000, 32 << 20
#: Rows up to which shared anchors and settled contexts are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Starts with one anchor, as long as the strings from these have so many offsets to it.
OFFSETS = (64, 16, 4, 1)
_BLOCK = 1 << 20
_BYTE_SYMBOLS, _PART = 258, 257  # bytes are 1..256, 0 ends the shard, 257 parts contexts
_RUN = "k1 bigint, k2 bigint, at bigint, n int, shift int, anchor bigint, d1 bigint, d2 bigint"


@dataclass(frozen=True)
class Limits:
    """Sizes that bound a shard and what its sort holds in memory; results do not depend on them."""

    group: int = GROUP
    shard_bytes: int = SHARD_BYTES
    memory: int = MEMORY
    spare: int = SPARE


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Anchors:
    """Anchors of all strings of ``width`` bytes of a buffer."""

    def __init__(self, width: int, anchor: int):
        base = 0x9E3779B97F4A7C15
        self._width, self._anchor = width, anchor
        self._bytes = np.frombuffer(b"".join(xxhash.xxh64_digest(bytes([c])) for c in range(256)), "<u8") | np.uint64(1)
        size = _BLOCK + width + 1
        self._up, self._down = _powers(base, size), _powers(pow(base, -1, 1 << 64), size)

    def pick(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each string's anchor position in ``data``, and the hashes of all anchors of ``data``."""
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self._bytes[data] * self._up[: len(data)], out=sums[1:])
        count = len(data) - self._anchor + 1
        hashes = (sums[self._anchor :] - sums[: -self._anchor]) * self._down[:count]
        hashes ^= hashes >> np.uint64(29)
        hashes *= np.uint64(0xBF58476D1CE4E5B9)
        hashes ^= hashes >> np.uint64(32)
        # Smallest hash first, then the rightmost place; then the smallest of each window in linear time.
        places = np.uint64((1 << (_BLOCK + self._width).bit_length()) - 1)
        keys = (hashes & ~places) | (places - np.arange(count, dtype=np.uint64))
        window = self._width - self._anchor + 1
        grid = np.concatenate([keys, np.full(-count % window, ~np.uint64(0))]).reshape(-1, window)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        strings = count - window + 1
        best = np.minimum(back[:strings], ahead[window - 1 : window - 1 + strings])
        return (places - (best & places)).astype(np.int64), hashes


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column (null: none), and where each value begins and ends."""
    values = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = values.buffers()[2]
    return np.frombuffer(data if data else b"", np.uint8), offsets


def _digests(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128-bit hashes of byte ranges, as two columns."""
    view = memoryview(data)
    each = (xxhash.xxh3_128_digest(view[s:e]) for s, e in zip(begins.tolist(), ends.tolist(), strict=True))
    return np.frombuffer(b"".join(each), "<i8").reshape(-1, 2)


def _run_batch(keys: list[np.ndarray], *columns: np.ndarray) -> pa.RecordBatch:
    kinds = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.int64()] * 3
    arrays = [pa.array(c, k) for c, k in zip([*keys, *columns], kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in _RUN.split(", ")])


def _blocks(offsets: np.ndarray, width: int) -> Iterator[tuple[int, int, int, int]]:
    """``(begin, end, first, last)``: byte ranges of a bounded size and the texts in them.

    Whole texts go together; a longer one is cut at multiples of the block
    size from its own begin, so runs depend on their text alone.
    """
    first = 0
    while first < len(offsets) - 1:
        begin = int(offsets[first])
        last = max(int(np.searchsorted(offsets, begin + _BLOCK, "right")) - 1, first + 1)
        end = int(offsets[last])
        for at in range(begin, max(end - width, begin) + 1, _BLOCK):
            yield at, min(at + _BLOCK + width - 1, end), first, last
        first = last


def _text_runs(width: int, anchor: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Runs of whole texts (columns ``k1, k2, text``): starts of strings that share an anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(width, anchor)
        for b in batches:
            data, offsets = _flat(b.column(2))
            k1, k2 = b.column(0).to_numpy(), b.column(1).to_numpy()
            for at, stop, low, high in _blocks(offsets, width):
                if stop - at < width:
                    continue
                part = data[at:stop]
                places, hashes = anchors.pick(part)
                count = len(places)
                # Starts whose string lies within one text.
                begin, end = offsets[low:high], offsets[low + 1 : high + 1] - width + 1
                first, last = np.clip(begin - at, 0, count), np.clip(end - at, 0, count)
                some = last > first
                inside, fresh = np.zeros(count + 1, np.int64), np.append(True, places[1:] != places[:-1])
                np.add.at(inside, first[some], 1)
                np.add.at(inside, last[some], -1)
                fresh[first[some]] = True
                starts = np.flatnonzero(fresh & (np.cumsum(inside[:-1]) > 0))
                if not len(starts):
                    continue
                own = np.flatnonzero(some)[np.searchsorted(first[some], starts, "right") - 1]
                stops = np.minimum(np.append(starts[1:], count), last[own])
                digests = _digests(part, starts, stops + width - 1)
                yield _run_batch(
                    [k1[low + own], k2[low + own]], starts + at - begin[own], stops - starts, places[starts] - starts,
                    hashes[places[starts]].view(np.int64), digests[:, 0], digests[:, 1],
                )

    return run


def _context_runs(width: int, offsets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Runs of contexts (``k1, k2, text, n, shift``): starts by offset to their anchor, ``offsets`` of them together.

    What all strings of those offsets have in common is the new key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4096):
            data, begins = _flat(b.column(2))
            begins = begins[:-1]
            n, shift = b.column(3).to_numpy().astype(np.int64), b.column(4).to_numpy().astype(np.int64)
            # Offsets go from shift - n + 1 (last start) to shift; runs are their blocks of equal quotient.
            low, high = (shift - n + 1) // offsets, shift // offsets
            own = np.repeat(np.arange(len(n)), high - low + 1)
            block = high[own] - (np.arange(len(own)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1))
            earliest, latest = shift[own] - (block + 1) * offsets + 1, shift[own] - block * offsets
            first, stop = np.maximum(earliest, 0), np.minimum(latest + 1, n[own])
            at = begins[own]
            shared = _digests(data, at + latest, at + earliest + width)
            digests = _digests(data, at + first, at + stop + width - 1)
            k1, k2 = b.column(0).to_numpy(), b.column(1).to_numpy()
            yield _run_batch(
                [k1[own], k2[own]], first, stop - first, shift[own] - first,
                shared[:, 0] ^ block, digests[:, 0], digests[:, 1],
            )

    return run


def _contexts(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``(k1, k2, text, n, shift, anchor, large)`` of the wanted runs of each row (``text, places``)."""
    names = ["k1", "k2", "text", "n", "shift", "anchor", "large"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            data, begins = _flat(b.column(0))
            places = b.column(1)
            at, n, shift, anchor, d1, d2, large = places.flatten().flatten()
            begin = np.repeat(begins[:-1], places.value_lengths().to_numpy()) + at.to_numpy()
            view, end = memoryview(data), begin + n.to_numpy() + width - 1
            cut = [bytes(view[s:e]) for s, e in zip(begin.tolist(), end.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([d1, d2, pa.array(cut, pa.binary()), n, shift, anchor, large], names)

    return run


def shard_repeats(contexts: Iterator[tuple[bytes, int]], width: int, memory: int, files: Files) -> Iterator[list[tuple[int, int]]]:
    """For each context ``(bytes, starts)`` the ranges of starts whose string occurs twice in the shard.

    The shard's text, queues and marks are in ``files`` where they are large.
    """
    text, sizes = Writer(files, np.uint16), []
    for raw, n in contexts:
        text.add(np.append(np.frombuffer(raw, np.uint8).astype(np.uint16) + 1, _PART))
        sizes.append((len(raw) + 1, n))
    text.add(np.zeros(1, np.uint16))
    x = text.close()[0]
    repeated = files.array(np.bool_, len(x))
    repeated[:] = False
    before = 0
    for positions, common in sorted_suffixes(x, _BYTE_SYMBOLS, width, memory, files):
        alike = common >= width
        repeated[positions[alike]] = True
        repeated[np.append(before, positions[:-1])[alike]] = True
        before = positions[-1]
    at = 0
    for size, n in sizes:
        marks = np.diff(np.concatenate([[0], repeated[at : at + n].astype(np.int8), [0]]))
        yield list(zip(np.flatnonzero(marks == 1).tolist(), np.flatnonzero(marks == -1).tolist(), strict=True))
        at += size


def _sorted_shards(width: int, memory: int, spare: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Repeated starts ``(d1, d2, low, high)`` of the contexts of one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []

        def contexts() -> Iterator[tuple[bytes, int]]:
            for b in slices(batches):
                keys.append(np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], axis=1))
                yield from zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)

        with tempfile.TemporaryDirectory() as folder:  # of this task alone, gone with it
            ranges = list(shard_repeats(contexts(), width, memory, Files(folder, spare)))
        if not ranges:
            return
        key = np.repeat(np.concatenate(keys), [len(r) for r in ranges], axis=0)
        low, high = np.array([x for r in ranges for x in r], np.int64).reshape(-1, 2).T
        arrays = [pa.array(c, pa.int64()) for c in (key[:, 0], key[:, 1], low, high)]
        yield pa.RecordBatch.from_arrays(arrays, ["d1", "d2", "low", "high"])

    return run


def _side(rows: DataFrame) -> DataFrame:
    """A staged side of a join: broadcast if its rows are few (16 to 32 bytes each), else shuffled and open to splitting."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows.hint("rebalance")


def _repeated(sources: DataFrame, cutter: Callable, width: int, limits: Limits, offsets: tuple[int, ...]) -> DataFrame:
    """``(k1, k2, low, high)``: ranges of starts in the sources' texts whose string occurs twice.

    ``sources`` (``k1, k2, text`` and what ``cutter`` takes) with equal keys
    have equal texts.
    """
    runs = sources.mapInArrow(cutter, _RUN)  # found twice: cheaper than keeping them
    names = ["k1", "k2", "at", "n", "shift", "anchor"]
    classes = stage(
        runs.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in names]), "classes"
    )
    sizes = F.count(F.lit(1)).alias("contexts"), F.sum(F.col("n") + F.lit(width - 1)).alias("bytes")
    shared = stage(classes.groupBy("anchor").agg(*sizes).where("contexts > 1"), "shared")
    small = F.col("contexts") <= limits.group
    total, large = shared.agg(F.sum(F.when(small, F.col("bytes"))), F.count_if(~small)).first()
    place = F.struct("at", "n", "shift", "anchor", "d1", "d2", (~small).alias("large"))
    wanted = classes.join(_side(shared), "anchor").groupBy("k1", "k2").agg(F.collect_list(place).alias("places"))
    texts = sources.select("k1", "k2", F.col("text").cast("binary").alias("text")).dropDuplicates(["k1", "k2"])
    contexts = (
        texts.join(wanted, ["k1", "k2"])
        .select("text", "places")
        .mapInArrow(_contexts(width), "k1 bigint, k2 bigint, text binary, n int, shift int, anchor bigint, large boolean")
    )
    settled = classes.where("copies > 1").select("d1", "d2", F.lit(0).cast("bigint").alias("low"), F.col("n").cast("bigint").alias("high"))
    if large:
        contexts = stage(contexts, "contexts")
        rest = contexts.where("large").select("k1", "k2", "text", "n", "shift")
        deeper = _repeated(rest, _context_runs(width, offsets[0]), width, limits, offsets[1:])
        settled = settled.unionByName(deeper.select(F.col("k1").alias("d1"), F.col("k2").alias("d2"), "low", "high"))
    if total:
        dealt = contexts.where("NOT large").select("k1", "k2", "text", "n", "anchor").repartition(-(-total // limits.shard_bytes), "anchor")
        sort = _sorted_shards(width, limits.memory, limits.spare)
        settled = settled.unionByName(dealt.drop("anchor").mapInArrow(sort, "d1 bigint, d2 bigint, low bigint, high bigint"))
    return runs.select("k1", "k2", "at", "d1", "d2").join(_side(stage(settled, "settled")), ["d1", "d2"]).select(
        "k1", "k2", (F.col("at") + F.col("low")).alias("low"), (F.col("at") + F.col("high")).alias("high")
    )


def _merged(ranges: list[dict], width: int) -> list[tuple[int, int]]:
    """Maximal byte spans that strings of ``width`` bytes from these ranges of starts cover."""
    spans: list[tuple[int, int]] = []
    for low, high in sorted((r["low"], r["high"] + width - 1) for r in ranges):
        if spans and low <= spans[-1][1]:
            spans[-1] = spans[-1][0], max(high, spans[-1][1])
        else:
            spans.append((low, high))
    return spans


def _keys(columns: tuple[str, str]) -> list[Column]:
    text = F.coalesce(columns[1], F.lit(""))
    return [F.xxhash64(columns[0], text).alias("k1"), F.xxhash64(F.lit("second"), text, columns[0]).alias("k2")]


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = WIDTH,
    anchor: int = ANCHOR,
    limits: Limits = Limits(),
) -> DataFrame:
    """``(doc_id, n_bytes, spans, kept)``, one row per document.

    Every byte goes that a string of ``width`` bytes covers which starts
    anywhere else, too: in another text, or again in the same one (such
    strings may overlap). Strings never cross documents and are judged on the
    input. ``spans`` are the maximal removed byte ranges ``[begin, end)`` in
    order, ``kept`` the bytes left.

    Null texts count as empty; texts shorter than ``width`` bytes stay whole.
    Rows that repeat an id are documents of their own, rows that repeat id and
    text, too (so both lose every byte if long enough). An empty table gives
    an empty result.
    """
    anchor = min(anchor, width)
    d = pick(docs, doc_id=id_col, text=text_col)
    keyed = d.select("doc_id", *_keys(("doc_id", "text")), "text")
    offsets = tuple(x for x in OFFSETS if x <= max(1, width - anchor))
    starts = _repeated(keyed.select("k1", "k2", "text"), _text_runs(width, anchor), width, limits, offsets)
    ranges = starts.groupBy("k1", "k2").agg(F.collect_list(F.struct("low", "high")).alias("ranges")).hint("rebalance")
    names = ["doc_id", "n_bytes", "spans", "kept"]
    span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 128):
            sizes, spans, kept = [], [], []
            for text, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw, at, parts = (text or "").encode("utf-8"), 0, []
                own = _merged(found or [], width)
                for low, high in own:
                    parts.append(raw[at:low])
                    at = high
                sizes.append(len(raw))
                spans.append([{"begin": low, "end": high} for low, high in own])
                kept.append(b"".join([*parts, raw[at:]]))
            arrays = [b.column(0), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names)

    joined = keyed.join(ranges, ["k1", "k2"], "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(
        run, f"doc_id {sql_type(d, 'doc_id')}, n_bytes bigint, spans array<struct<begin:bigint,end:bigint>>, kept binary"
    )
