"""Secret scans through a trigram inverted index.

Each rule is a regular expression. Its syntax tree gives a Boolean query over
trigrams that every match must contain (as in Cox, "Regular Expression Matching
with a Trigram Index"): a run of literals, small character classes and
alternatives expands to the strings it can spell, of which one must occur, so
all trigrams of that one. Each slice of documents in a task is a shard with its
own inverted index (trigram to posting list of the shard's documents, for the
trigrams that some rule asks for). Posting lists are intersected and united,
and the regular expression verifies the candidates. A rule without mandatory
trigrams scans every document. Texts stay in their task: nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from re import _parser as syntax

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tablelens.llm.common import pick, slices, sql_type

#: Strings that a run may expand to, and characters that a class may stand for.
MAX_STRINGS, MAX_CLASS = 64, 8
#: Text bytes that are looked up at once, and texts per shard.
CHUNK, SHARD = 4_000_000, 512

#: AND of clauses, each an OR of alternatives, each an AND of trigrams.
Query = list[list[frozenset[bytes]]]


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, and the group that needs ``least`` characters."""

    kind: str
    pattern: str
    flags: int = re.ASCII
    group: int = 0
    least: int = 1


# The three base kinds of the contract.
BASE_RULES = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        re.ASCII | re.IGNORECASE,
        group=2,
        least=6,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]+", least=24),
)
# Published formats of other credentials.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{24,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)


# --------------------------------------------------- trigram queries of rules


def _folds(c: str) -> bool:
    """Whether a character matches others than its ASCII lower and upper case where Unicode case is ignored."""
    return c.lower() in "iks" or not c.isascii()


def _spellings(node: tuple, folded: bool) -> set[str] | None:
    """Every string that a syntax node can spell, or None if too many or (``folded``) open to Unicode case folding."""
    op, value = str(node[0]), node[1]
    if op == "LITERAL":
        return None if folded and _folds(chr(value)) else {chr(value)}
    if op == "AT":
        return {""}
    if op == "SUBPATTERN":
        return _all_spellings(value[3], folded)
    if op == "BRANCH":
        found = [_all_spellings(b, folded) for b in value[1]]
        return set().union(*found) if all(f is not None for f in found) else None
    if op == "IN":
        some: set[str] = set()
        for kind, v in value:
            if str(kind) == "LITERAL":
                some.add(chr(v))
            elif str(kind) == "RANGE" and v[1] - v[0] < MAX_CLASS:
                some |= {chr(c) for c in range(v[0], v[1] + 1)}
            else:
                return None
        return some if len(some) <= MAX_CLASS and not (folded and any(map(_folds, some))) else None
    if op in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        least, most, inner = int(value[0]), value[1], value[2]
        once = _all_spellings(inner, folded)
        if once is None or most == syntax.MAXREPEAT or int(most) > 8:
            return None
        power, total = {""}, {""} if least == 0 else set()
        for k in range(1, int(most) + 1):
            power = {a + b for a in power for b in once}
            if len(power) > MAX_STRINGS:
                return None
            if k >= least:
                total |= power
        return total
    return None


def _all_spellings(nodes, folded: bool) -> set[str] | None:
    out = {""}
    for node in nodes:
        found = _spellings(node, folded)
        if found is None or len(found) * len(out) > MAX_STRINGS:
            return None
        out = {a + b for a in out for b in found}
    return out


def _trigrams(text: str) -> frozenset[bytes]:
    data = text.encode("utf-8").lower()
    return frozenset(data[i : i + 3] for i in range(len(data) - 2))


def trigram_query(pattern: str, flags: int = 0) -> Query:
    """What every match must contain, over ASCII-lower-cased text; [] if nothing is sure.

    Where a pattern ignores case beyond ASCII (also by ``(?i)`` within it),
    letters that fold to others ("s" to a long s) make no trigram.
    """
    clauses: Query = []
    ignores = flags & re.IGNORECASE or re.search(r"\(\?[aLmsux]*i", pattern)
    folded = bool(ignores) and not flags & re.ASCII

    def close(run: set[str]) -> None:
        wanted = [_trigrams(s) for s in sorted(run)]
        if all(wanted):
            clauses.append(wanted)

    def walk(nodes) -> None:
        run = {""}
        for node in nodes:
            found = _spellings(node, folded)
            if found is not None and len(found) * len(run) <= MAX_STRINGS:
                run = {a + b for a in run for b in found}
                continue
            close(run)
            run = {""}
            op, value = str(node[0]), node[1]
            if op == "SUBPATTERN":
                walk(value[3])
            elif op.endswith("_REPEAT") and int(value[0]) > 0:
                walk(value[2])
        close(run)

    walk(syntax.parse(pattern, flags))
    return clauses


# ---------------------------------------------------------- index of a shard


class TrigramIndex:
    """Posting lists of one shard for the trigrams that the queries ask for."""

    def __init__(self, wanted: list[bytes]):
        self._number = {t: n for n, t in enumerate(wanted, 1)}
        self._table = np.zeros(1 << 24, dtype=np.uint16)
        for t, n in self._number.items():
            self._table[int.from_bytes(t, "big")] = n

    def build(self, data: bytes, starts: np.ndarray) -> None:
        """``data``: the shard's texts end to end, lower-cased; ``starts``: where each begins."""
        self.n = len(starts)
        raw, pairs = np.frombuffer(data, dtype=np.uint8), [np.empty(0, dtype=np.int64)]
        for at in range(0, max(len(raw) - 2, 0), CHUNK):
            part = raw[at : at + CHUNK + 2].astype(np.uint32)
            number = self._table[(part[:-2] << 16) | (part[1:-1] << 8) | part[2:]]
            where = np.flatnonzero(number)
            doc = np.searchsorted(starts, where + at, side="right") - 1
            pairs.append(np.unique(number[where].astype(np.int64) * self.n + doc))
        found = np.unique(np.concatenate(pairs))
        cuts = np.searchsorted(found, np.arange(len(self._number) + 2) * self.n)
        self._postings = [found[a:b] % self.n for a, b in zip(cuts, cuts[1:], strict=False)]

    def candidates(self, query: Query) -> np.ndarray:
        """Documents that satisfy ``query``: all of them for an empty one."""
        docs = np.arange(self.n)
        for clause in query:
            some = np.empty(0, dtype=np.int64)
            for trigrams in clause:
                lists = sorted((self._postings[self._number[t]] for t in trigrams), key=len)
                own = lists[0]
                for other in lists[1:]:
                    own = np.intersect1d(own, other, assume_unique=True)
                some = np.union1d(some, own)
            docs = np.intersect1d(docs, some, assume_unique=True)
        return docs


def spans_of(rule: Rule, regex: re.Pattern, text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches whose group is long enough."""
    return [m.span() for m in regex.finditer(text) if len(m[rule.group]) >= rule.least]


# ------------------------------------------------------------------ operator


def scan_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    base: tuple[Rule, ...] = BASE_RULES,
    more: tuple[Rule, ...] = MORE_RULES,
) -> DataFrame:
    """Secret spans of every row's whole text.

    Columns: ``doc_id``, ``n_<kind>`` for each base rule, ``base_sha256`` (of
    the base spans as ``kind:start:end``, by start, then kind as listed, joined
    by commas; code points, end exclusive) and ``spans`` (base and other
    rules', joined likewise; empty if none). Null texts count as empty; null
    and repeated ids are passed through, row by row; an empty table gives an
    empty result.
    """
    d = pick(docs, doc_id=id_col, text=text_col)
    rules = (*base, *more)
    queries = [trigram_query(r.pattern, r.flags) for r in rules]
    wanted = sorted({t for q in queries for clause in q for alternative in clause for t in alternative})
    names = ["doc_id", *[f"n_{r.kind}" for r in base], "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = TrigramIndex(wanted)
        compiled = [re.compile(r.pattern, r.flags) for r in rules]
        for b in slices(batches, SHARD):
            texts = [t or "" for t in b.column(1).to_pylist()]
            encoded = [t.encode("utf-8").lower() for t in texts]
            starts = np.concatenate(([0], np.cumsum([len(e) for e in encoded])[:-1])) if texts else np.empty(0, int)
            index.build(b"".join(encoded), starts)
            found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
            for k, (rule, regex, query) in enumerate(zip(rules, compiled, queries, strict=True)):
                for i in index.candidates(query).tolist():
                    found[i] += [(s, k, e) for s, e in spans_of(rule, regex, texts[i])]
            columns: list[list] = [[] for _ in names[1:]]
            for some in found:
                some.sort()
                counts = Counter(k for _, k, _ in some)
                spelled = [(k, f"{rules[k].kind}:{s}:{e}") for s, k, e in some]
                own = ",".join(x for k, x in spelled if k < len(base))
                row = [counts[k] for k in range(len(base))]
                row += [hashlib.sha256(own.encode()).hexdigest(), ",".join(x for _, x in spelled)]
                for c, v in zip(columns, row, strict=True):
                    c.append(v)
            kinds = [pa.int64()] * len(base) + [pa.string()] * 2
            made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *made], names)

    counts = "".join(f", n_{r.kind} bigint" for r in base)
    return d.mapInArrow(run, f"doc_id {sql_type(d, 'doc_id')}{counts}, base_sha256 string, spans string")
