"""External induced sorting of suffixes, with the common prefixes of neighbours.

Suffixes that start where a descent ends (S* positions) are sorted first: the
pieces between them are ordered by one induction, get names, and the shorter
string of names is sorted in the same way, level by level, until it fits into
the memory given. Two more inductions then sort all suffixes of a level: one
in ascending order places the suffixes that are larger than their successor
(L), one in descending order those that are smaller (S). Each takes suffix
tuples from a priority queue by their first symbol and puts the tuple of the
preceding position back, so equal first symbols leave in the order of what
follows them (SAIS, Nong et al.; eSAIS, Bingmann et al.).

A tuple carries the common prefix of its suffix with its neighbour: one more
than the smallest common prefix between the two suffixes that put both into the
queue. Prefixes count up to ``cap`` symbols; what is equal in that many symbols
may stand in any order.

Queues hold a bounded number of tuples and write sorted runs to files beyond
it; strings and sorted lists of more than a few megabytes are files, too, read
and written in blocks or by memory map. Nothing outlives the sort.
"""

from __future__ import annotations

import heapq
import os
from collections import defaultdict
from collections.abc import Iterator

import numpy as np

#: Tuples that go through one step at a time.
BLOCK = 1 << 16
Batch = tuple[np.ndarray, np.ndarray]


class Files:
    """Arrays of a sort: up to ``spare`` bytes each in memory, larger ones in files of one folder.

    A file has no name any more once it is mapped, so its space is free as soon
    as its array is.
    """

    def __init__(self, folder: str, spare: int = 0):
        self._folder, self._made, self.spare = folder, 0, spare

    def path(self) -> str:
        self._made += 1
        return os.path.join(self._folder, f"{self._made}.bin")

    def unspared(self) -> Files:
        """Files of whatever size, in a folder of their own."""
        folder = self.path()
        os.mkdir(folder)
        return Files(folder)

    def array(self, kind: type, size: int) -> np.ndarray:
        if size * np.dtype(kind).itemsize <= self.spare or not size:
            return np.empty(size, kind)
        path = self.path()
        made = np.memmap(path, kind, "w+", shape=(size,))
        os.unlink(path)
        return made


class Writer:
    """Columns appended batch by batch, then read as arrays."""

    def __init__(self, files: Files, *kinds: type):
        self._files, self._kinds, self.size = files, kinds, 0
        self._held: list[list[np.ndarray]] = [[] for _ in kinds]
        self._bytes, self._paths, self._open = 0, [], []

    def add(self, *columns: np.ndarray) -> None:
        for held, c, kind in zip(self._held, columns, self._kinds, strict=True):
            held.append(np.array(c, kind))
            self._bytes += held[-1].nbytes
        self.size += len(columns[0])
        if self._open or self._bytes > self._files.spare:
            self._flush()

    def _flush(self) -> None:
        if not self._open:
            self._paths = [self._files.path() for _ in self._kinds]
            self._open = [open(p, "wb") for p in self._paths]
        for f, held in zip(self._open, self._held, strict=True):
            for part in held:
                f.write(part.data)
            held.clear()

    def close(self) -> list[np.ndarray]:
        if not self._open:
            return [np.concatenate([*held, np.empty(0, kind)]) for held, kind in zip(self._held, self._kinds, strict=True)]
        made = []
        for f, p, kind in zip(self._open, self._paths, self._kinds, strict=True):
            f.close()
            made.append(np.memmap(p, kind, "r") if self.size else np.empty(0, kind))
            os.unlink(p)
        return made


class TupleQueue:
    """Suffix tuples by first symbol, smallest (or largest) first; equal symbols leave as they came.

    At most ``memory`` tuples stay in memory; beyond that all of them become a
    sorted run in files. Runs are older than what memory holds, and older runs
    come first.
    """

    def __init__(self, files: Files, memory: int, descending: bool):
        self._files, self._memory, self._sign = files, memory, -1 if descending else 1
        self._held: dict[int, list[Batch]] = defaultdict(list)
        self._order: list[int] = []  # heap of the held symbols, signed
        self._runs: list[list] = []  # [symbols (signed), positions, prefixes, next]
        self._count = 0

    def push(self, symbols: np.ndarray, positions: np.ndarray, prefixes: np.ndarray) -> None:
        """Tuples that are grouped by symbol."""
        cuts = np.flatnonzero(symbols[1:] != symbols[:-1]) + 1
        for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(symbols)], strict=True):
            if s < e:
                key = int(symbols[s]) * self._sign
                if key not in self._held:
                    heapq.heappush(self._order, key)
                self._held[key].append((positions[s:e], prefixes[s:e]))
        self._count += len(symbols)
        if self._count > self._memory:
            self._spill()

    def _spill(self) -> None:
        run = Writer(self._files.unspared(), np.int64, np.int64, np.uint16)
        for key in sorted(self._held):
            for positions, prefixes in self._held[key]:
                run.add(np.full(len(positions), key), positions, prefixes)
        self._runs.append([*run.close(), 0])
        self._held.clear()
        self._order.clear()
        self._count = 0

    def first(self) -> int | None:
        """The symbol that leaves next."""
        heads = [int(r[0][r[3]]) for r in self._runs]
        heads += self._order[:1]
        return min(heads) * self._sign if heads else None

    def pop(self) -> Iterator[Batch]:
        """All tuples of the first symbol that are in the queue now, in order, in blocks."""
        key = self.first() * self._sign
        held: list[Batch] = []
        if self._order and self._order[0] == key:
            heapq.heappop(self._order)
            held = self._held.pop(key)
            self._count -= sum(len(p) for p, _ in held)
        for run in [r for r in self._runs if r[0][r[3]] == key]:
            symbols, positions, prefixes, at = run
            end = at + int(np.searchsorted(symbols[at:], key, "right"))
            run[3] = end
            for s in range(at, end, BLOCK):
                e = min(end, s + BLOCK)
                yield np.array(positions[s:e]), np.array(prefixes[s:e])
        self._runs = [r for r in self._runs if r[3] < len(r[0])]
        if held:
            positions = np.concatenate([p for p, _ in held])
            prefixes = np.concatenate([x for _, x in held])
            for s in range(0, len(positions), BLOCK):
                yield positions[s : s + BLOCK], prefixes[s : s + BLOCK]


class _Scan:
    """One induction's pass over sorted suffixes of ``x``: puts preceding suffixes into its queue.

    ``prefixes`` off: tuples carry none (for sorting pieces).
    """

    def __init__(self, x: np.ndarray, queue: TupleQueue, cap: int, prefixes: bool, descending: bool, symbols: int, files: Files):
        self._x, self.queue, self._cap, self._descending = x, queue, cap, descending
        self._time = 0
        self._latest = np.full(cap + 1, -1)  # by common prefix: when it was last seen
        self._pushed = None
        if prefixes:
            self._pushed = files.array(np.int64, symbols)  # by symbol: when the scan last put a tuple into the queue
            self._pushed[:] = -1

    def step(self, positions: np.ndarray, prefixes: np.ndarray, symbol: int, strict: bool) -> None:
        """Suffixes that begin with ``symbol``, next in order, at most ``BLOCK``.

        ``prefixes[k]`` is what suffix k has in common with the one before it
        in the scan. ``strict``: a predecessor with the same symbol belongs to
        the other type.
        """
        before = self._x[np.maximum(positions, 1) - 1].astype(np.int64)
        wanted = before < symbol if self._descending else before > symbol
        if not strict:
            wanted |= before == symbol
        wanted &= positions > 0
        place = np.flatnonzero(wanted)
        target = before[place]
        order = np.argsort(target, kind="stable")
        place, target = place[order], target[order]
        common = self._common(place, target, prefixes) if self._pushed is not None else np.zeros(len(place), np.uint16)
        self._time += len(positions)
        if len(place):
            self.queue.push(target, positions[place] - 1, common)

    def _common(self, place: np.ndarray, target: np.ndarray, prefixes: np.ndarray) -> np.ndarray:
        """Common prefix of each pushed suffix with the one pushed before it to the same symbol."""
        cap, begin, m = self._cap, self._time, len(prefixes)
        out = np.zeros(len(place), np.uint16)
        if len(place):
            first = np.append(True, target[1:] != target[:-1])
            since = np.array(self._pushed[target[first]])
            upto = np.minimum.accumulate(prefixes)[place[first]]
            recent = np.minimum(np.searchsorted(np.maximum.accumulate(self._latest), since, "right"), cap)
            out[first] = np.where(since < 0, 0, np.minimum(np.minimum(recent, upto) + 1, cap))
            rest = np.flatnonzero(~first)
            if len(rest):
                low, high = place[rest - 1] + 1, place[rest]
                level = np.frexp(high - low + 1)[1] - 1  # floor of the binary logarithm
                smallest = prefixes
                for k in range(int(level.max()) + 1):
                    if k:
                        half = 1 << (k - 1)
                        smallest = np.minimum(smallest[:-half], smallest[half:])
                    some = level == k
                    least = np.minimum(smallest[low[some]], smallest[high[some] - (1 << k) + 1])
                    out[rest[some]] = np.minimum(least + 1, cap)
            last = np.append(first[1:], True)
            self._pushed[target[last]] = begin + place[last]
        seen = np.full(cap + 1, -1)
        seen[prefixes] = np.arange(m)  # the last one of equal prefixes stays
        self._latest = np.where(seen >= 0, begin + seen, self._latest)
        return out


def common_prefix(x: np.ndarray, i: int, j: int, cap: int) -> int:
    """Equal symbols of the suffixes at ``i`` and ``j``, at most ``cap``."""
    size = min(cap, len(x) - max(i, j))
    unequal = np.flatnonzero(x[i : i + size] != x[j : j + size])
    return int(unequal[0]) if len(unequal) else size


def _common_prefixes(x: np.ndarray, i: np.ndarray, j: np.ndarray, cap: np.ndarray) -> np.ndarray:
    """``common_prefix`` of many pairs, each with its own cap."""
    out = np.zeros(len(i), np.int64)
    live = np.flatnonzero(cap > 0)
    end, step = len(x) - 1, 0  # the last symbol is unlike all others
    while len(live):
        a, b = np.minimum(i[live] + step, end), np.minimum(j[live] + step, end)
        live = live[x[a] == x[b]]
        step += 1
        out[live] = step
        live = live[cap[live] > step]
    return out


def _descents(x: np.ndarray, files: Files) -> np.ndarray:
    """S* positions in ascending order: smaller than their successor, after one that is larger."""
    n = len(x)
    found, after, smaller = [], int(x[n - 1]), True  # the last symbol, smallest of all, counts as S
    begins = list(range(0, n - 1, BLOCK))
    parts = files.array(np.int64, n // 2 + 1)
    at = len(parts)
    pending = n - 1  # an S position whose predecessor is not seen yet
    for s in reversed(begins):
        part = np.asarray(x[s : min(s + BLOCK, n - 1)], np.int64)
        m = len(part)
        step = np.append(part[1:], after) - part  # to the successor: S if above 0
        known = np.where(step != 0, np.arange(m), m)
        nearest = np.minimum.accumulate(known[::-1])[::-1]  # next position that differs from its successor
        small = np.where(nearest < m, step[np.minimum(nearest, m - 1)] > 0, smaller)
        rises = np.append(small[1:], pending >= 0)
        found = np.flatnonzero(~small & rises) + s + 1
        at -= len(found)
        parts[at : at + len(found)] = found
        after, smaller, pending = int(part[0]), bool(small[0]), s if small[0] else -1
    return parts[at:]


def _induce(x: np.ndarray, seeds: Iterator[Batch], symbols: int, cap: int, prefixes: bool, memory: int, files: Files) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
    """All suffixes of ``x`` but its last in descending order, from sorted S* suffixes: whether S, positions, prefixes.

    ``seeds`` come in ascending order with their common prefixes with the seed
    before, in blocks of one first symbol each.
    """
    # Ascending: L suffixes of a symbol, then the seeds of that symbol.
    scan = _Scan(x, TupleQueue(files, memory, False), cap, prefixes, False, symbols, files)
    large = Writer(files, np.int64, np.uint16)
    seed = next(seeds, None)
    last, last_symbol = -1, -1
    while True:
        begin = int(x[seed[0][0]]) if seed else None
        symbol = scan.queue.first()
        if symbol is None and begin is None:
            break
        if begin is None or (symbol is not None and symbol <= begin):
            for positions, common in scan.queue.pop():
                scan.step(positions, common, symbol, False)
                large.add(positions, common)
                last, last_symbol = int(positions[-1]), symbol
            continue
        positions, common = seed
        if last_symbol == begin:  # the first seed after L suffixes of the same symbol
            common = common.copy()
            common[0] = common_prefix(x, last, int(positions[0]), cap) if prefixes else 0
            last_symbol = -1
        scan.step(positions, common, begin, True)
        seed = next(seeds, None)
    # Descending: S suffixes of a symbol, then its L suffixes.
    position, common = large.close()
    scan = _Scan(x, TupleQueue(files, memory, True), cap, prefixes, True, symbols, files)
    left = len(position)
    last, last_symbol, after = -1, -1, 0
    head = int(x[position[left - 1]]) if left else None
    while True:
        symbol = scan.queue.first()
        if symbol is None and head is None:
            return
        if head is None or (symbol is not None and symbol >= head):
            for some, shared in scan.queue.pop():
                scan.step(some, shared, symbol, False)
                yield True, some, shared
                last, last_symbol = int(some[-1]), symbol
            continue
        low = max(0, left - BLOCK)
        some = np.array(position[low:left][::-1])
        first = np.asarray(x[some])
        size = int(np.argmax(first != head)) if first[-1] != head else len(some)
        some, low = some[:size], left - size
        shared = np.empty(size, np.uint16)
        shared[1:] = common[low + 1 : left][::-1]
        if last_symbol == head:  # the first L suffix after S suffixes of the same symbol
            shared[0] = common_prefix(x, last, int(some[0]), cap) if prefixes else 0
            last_symbol = -1
        else:
            shared[0] = after if left < len(position) and int(x[position[left]]) == head else 0
        after = int(common[low])  # with the next larger L suffix, if that has the same symbol
        scan.step(some, shared, head, True)
        yield False, some, shared
        left = low
        head = int(x[position[left - 1]]) if left else None


def _by_symbol(x: np.ndarray, batches: Iterator[Batch]) -> Iterator[Batch]:
    """The same tuples in blocks of one first symbol."""
    for positions, common in batches:
        first = np.asarray(x[positions])
        cuts = np.flatnonzero(first[1:] != first[:-1]) + 1
        for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(positions)], strict=True):
            if s < e:
                yield positions[s:e], common[s:e]


def _names(x: np.ndarray, starts: np.ndarray, symbols: int, memory: int, files: Files) -> tuple[np.ndarray, int]:
    """The string of names of the pieces between S* positions, and its number of names."""
    count = len(starts)

    def unsorted() -> Iterator[Batch]:
        """S* positions by first symbol, through a queue."""
        queue = TupleQueue(files, memory, False)
        for s in range(0, count, BLOCK):
            part = np.array(starts[s : s + BLOCK])
            first = np.asarray(x[part], np.int64)
            order = np.argsort(first, kind="stable")
            queue.push(first[order], part[order], np.zeros(len(part), np.uint16))
        while queue.first() is not None:
            yield from queue.pop()

    ordinal = files.array(np.int64, count)
    ranks = files.array(np.int64, count)  # names in descending order, turned round below
    at, name, previous = 0, 0, None
    for small, positions, _ in _induce(x, unsorted(), symbols, 1, False, memory, files):
        if not small:
            continue
        before = x[np.maximum(positions, 1) - 1]
        positions = positions[(positions > 0) & (before > x[positions])]  # an S suffix after a larger one
        if not len(positions):
            continue
        own = np.searchsorted(starts, positions)
        size = np.where(own < count - 1, starts[np.minimum(own + 1, count - 1)] - positions + 1, 1)
        older = np.append(previous[0] if previous else positions[0], positions[:-1])
        older_size = np.append(previous[1] if previous else 0, size[:-1])
        alike = size == older_size
        same = np.zeros(len(positions), bool)
        if alike.any():
            same[alike] = _common_prefixes(x, positions[alike], older[alike], size[alike]) == size[alike]
        names = name + np.cumsum(~same)
        ordinal[at : at + len(own)] = own
        ranks[at : at + len(own)] = names
        at, name, previous = at + len(own), int(names[-1]), (int(positions[-1]), int(size[-1]))
    # The last position, the piece of the last symbol alone, is the smallest and not induced.
    ordinal[at], ranks[at] = count - 1, name + 1
    names = files.array(np.int64, count)
    for s in range(0, count, BLOCK):
        names[ordinal[s : s + BLOCK]] = name + 1 - ranks[s : s + BLOCK]
    return names, name + 1


def sort_in_memory(x: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of ``x`` (last symbol unique) and common prefixes, by doubling.

    Prefixes of neighbours count up to ``cap``; suffixes equal in that many
    symbols stand in any order.
    """
    n = len(x)
    order = np.argsort(x, kind="stable")
    rank = np.empty(n, np.int32)
    ordered = x[order]
    heads = np.append(True, ordered[1:] != ordered[:-1])
    rank[order] = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
    levels, width = [rank], 1
    while width < cap:
        slot = np.flatnonzero(~(heads & np.append(heads[1:], True)))  # slots of suffixes that are not alone
        if not len(slot):
            break
        some = order[slot]
        follower = np.minimum(some + width, n - 1)
        key = rank[some].astype(np.int64) << 32 | rank[follower]
        turn = np.argsort(key, kind="stable")
        key = key[turn]
        order[slot] = some[turn]
        fresh = np.append(True, key[1:] != key[:-1])
        heads[slot] = fresh
        rank = rank.copy()
        rank[order[slot]] = np.maximum.accumulate(np.where(fresh, slot, 0))
        levels.append(rank)
        width *= 2
    common = np.zeros(n, np.int64)
    i, j = order[:-1], order[1:]
    for k in range(len(levels) - 1, -1, -1):
        a, b = i + common[1:], j + common[1:]
        alike = levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)]
        common[1:] += alike.astype(np.int64) << k
    return order, np.minimum(common, cap)


def sorted_suffixes(x: np.ndarray, symbols: int, cap: int, memory: int, files: Files) -> Iterator[Batch]:
    """All suffixes of ``x`` in descending order: positions, and symbols in common with the suffix before (at most ``cap``).

    ``x`` holds whole numbers below ``symbols`` and ends with a 0 that occurs
    nowhere else; it may be a memory map. ``memory`` bounds the tuples that a
    queue holds and the names that are sorted in memory; ``files`` takes the rest.
    """
    n = len(x)
    if n > 1:
        starts = _descents(x, files)
        names, count = _names(x, starts, symbols, memory, files)
        seeds = Writer(files, np.int64, np.uint16)
        previous = -1
        for own, shared in _level(names, count, cap, memory, files):
            positions = np.asarray(starts[own])
            older = np.append(previous, own[:-1])
            # Names in common stand for the symbols up to where they differ; the rest is compared.
            shared = shared.astype(np.int64)
            last = len(starts) - 1
            here, there = starts[np.minimum(own + shared, last)], starts[np.minimum(np.maximum(older, 0) + shared, last)]
            symbols_in_common = np.minimum(here - positions, cap)
            more = _common_prefixes(x, np.asarray(here), np.asarray(there), np.where(older >= 0, cap - symbols_in_common, 0))
            seeds.add(positions, np.minimum(symbols_in_common + more, cap))
            previous = int(own[-1])
        position, common = seeds.close()

        def ascending() -> Iterator[Batch]:
            for high in range(len(position), 0, -BLOCK):
                low = max(0, high - BLOCK)
                # What a seed shares with the one before it stands with the smaller one's successor.
                own = np.append(common[low + 1 : high], common[high] if high < len(common) else 0)
                yield np.array(position[low:high][::-1]), own[::-1].astype(np.uint16)

        for _, some, shared in _induce(x, _by_symbol(x, ascending()), symbols, cap, True, memory, files):
            yield some, shared
    yield np.array([n - 1]), np.zeros(1, np.uint16)


def _level(names: np.ndarray, count: int, cap: int, memory: int, files: Files) -> Iterator[Batch]:
    """The suffixes of a string of names in descending order, in memory if it fits."""
    if len(names) > memory:
        yield from sorted_suffixes(names, count, cap, memory, files)
        return
    order, common = sort_in_memory(np.asarray(names), cap)
    # Ascending prefixes are with the smaller neighbour, descending ones with the larger.
    shared = np.append(common[1:], 0)
    for high in range(len(order), 0, -BLOCK):
        low = max(0, high - BLOCK)
        yield order[low:high][::-1], shared[low:high][::-1].astype(np.uint16)
