"""Benchmark decontamination by spaced-seed hashing (DataFrame functions only).

A mask slides over the words of a text and hashes the words at its kept
positions, ignoring the others, so a substituted word at an ignored position
does not hide a copy (spaced seeds, Ma, Tromp and Li 2002). Benchmark and
document hashes are joined; each hit fixes how an item would lie in the
document, and the aligned words around the hit decide.

The two default masks were chosen together: at least one of them hits every
copy of 14 words with any 2 substituted, 15 with any 3, and 20 with any 4.
Items of fewer than 12 words have further masks by their number of words, so
that they too lose no copy with as many substitutions as 0.8 of the words allow
(none up to 4 words, 1 from 5 to 9, 2 of 10 and 11).

A seed that more than ``SHARED`` places of the benchmark have (an instruction
line that many items begin with) would join each of its hits with all of them.
Such a hit is joined by one more word instead: seed, offset and word of the item
at that offset, where no more than ``SHARED`` places have the three ("rare").
Of a window with more rare words than may disagree at least one agrees, so as
many rare words next to the seed, on both sides, find every leak; only a place
with a window of fewer rare words (an item that differs from many others in a
few words) keeps the seed alone, and there the others leak with it.

Only the benchmark side is broadcast, in blocks of at most ``max_seeds`` hashes
(as many joins as that takes). Documents are tokenised once per block and never
shuffled; what is shuffled is one row per alignment with a hit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.llm.common import pick, restore, stage, with_keys

MASKS = ("110111", "100001111")
#: Further masks of short items, each with the least and most words of its items.
SHORT_MASKS = {
    "1": (1, 1),
    "11": (2, 2),
    "111": (3, 3),
    "1111": (4, 11),
    "10111": (5, 5),
    "11011": (5, 5),
    "11101": (5, 5),
    "110011": (6, 6),
}
#: Share of aligned words that must agree, and the words over which it counts.
SIMILARITY, WINDOW = 0.8, 20
#: Places of the benchmark that may have one seed, or one seed and word, in common.
SHARED = 8
#: Bound on the hashes broadcast at once (some 60 MB on an executor).
MAX_SEEDS = 1_000_000


def word_hashes(text: Column) -> Column:
    """Hash of each lower-cased word (a run of letters and digits) of a text."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _seed(words: Column, at: Column, mask: str, number: int) -> Column:
    """Hash of the mask's kept words from 0-based position ``at``; null where it does not fit."""
    kept = [F.get(words, at + F.lit(i)) for i, c in enumerate(mask) if c == "1"]
    return F.when(at + F.lit(len(mask)) <= F.size(words), F.xxhash64(F.lit(number), *kept))


def _placed(df: DataFrame, shortest: int, at: str) -> DataFrame:
    """One row per position ``at`` from which a mask of ``shortest`` words fits."""
    places = F.sequence(F.lit(0), F.size("words") - F.lit(shortest))
    return df.where(F.size("words") >= shortest).select("*", F.explode(places).alias(at))


def _item_seeds(items: DataFrame, masks: list[str], bounds: dict[int, tuple[int, int]]) -> DataFrame:
    """One row per position and mask that fits and is for items of that size: ``mask`` (number) and ``seed``."""

    def seed(number: int, mask: str) -> Column:
        own = _seed(F.col("words"), F.col("item_at"), mask, number)
        return F.when(F.size("words").between(*bounds[number]), own) if number in bounds else own

    each = F.posexplode(F.array(*[seed(n, m) for n, m in enumerate(masks)])).alias("mask", "seed")
    return _placed(items, min(map(len, masks)), "item_at").select("*", each).where("seed IS NOT NULL")


def _doc_seeds(docs: DataFrame, masks: list[str], used: list[int]) -> DataFrame:
    """One row per position and used mask: columns of ``docs``, ``at`` and ``seed``."""
    each = F.explode(F.array(*[_seed(F.col("words"), F.col("at"), masks[n], n) for n in used]))
    return _placed(docs, min(len(masks[n]) for n in used), "at").select("*", each.alias("seed"))


def _probes(seeds: DataFrame, masks: list[str], shared: int, similarity: float, window: int) -> tuple[DataFrame, DataFrame]:
    """Places of the benchmark by what finds them: ``(seed, item_key, item_at, n_words)`` and ``(seed, word, ...)``.

    ``seeds`` has ``mask, seed, item_key, item_at, n_words, words``. ``word``
    is the hash of seed, offset and word; see the module's text.
    """
    place = ["seed", "item_key", "item_at", "n_words"]
    many = seeds.groupBy("seed").agg(F.count(F.lit(1)).alias("places")).where(F.col("places") > shared)
    plain = seeds.join(many, "seed", "left_anti").select(*place)
    length = F.element_at(F.array(*[F.lit(len(m)) for m in masks]), F.col("mask") + 1)
    often = seeds.join(many.select("seed"), "seed").withColumn("size", length)
    # Each word that a window around the seed may have, with its place in the item.
    low, high = F.greatest(F.col("item_at") - F.lit(window - 1), F.lit(0)), F.least(F.col("item_at") + F.lit(window), F.col("n_words"))
    near = often.select(*place, "size", "words", F.explode(F.sequence(low, high - 1)).alias("j")).withColumn(
        "word", _word(F.col("seed"), F.col("j") - F.col("item_at"), F.get("words", F.col("j")))
    )
    rare = near.groupBy("word").agg(F.count(F.lit(1)).alias("places")).where(F.col("places") <= shared).select("word")
    own = near.join(rare, "word").groupBy(*place, "size").agg(F.array_sort(F.collect_list(F.struct("j", "word"))).alias("rare"))
    # Windows of the seed with too few rare words to be sure of one that agrees.
    span = F.least(F.col("n_words"), F.lit(window))
    wrong = span - F.floor(span * F.lit(similarity)).cast("int")
    begins = F.sequence(F.greatest(F.col("item_at") + F.col("size") - span, F.lit(0)), F.least(F.col("item_at"), F.col("n_words") - span))
    poor = F.exists(begins, lambda b: F.size(F.filter("rare", lambda r: (r["j"] >= b) & (r["j"] < b + span))) <= wrong)
    sure = own.where(~poor)
    unsure = often.join(sure.select("seed", "item_key", "item_at"), ["seed", "item_key", "item_at"], "left_anti").select(*place)
    # The nearest rare words: as many on either side as any window needs, and those between.
    before = F.filter("rare", lambda r: r["j"] < F.col("item_at"))
    behind = F.filter("rare", lambda r: r["j"] >= F.col("item_at") + F.col("size"))
    between = F.filter("rare", lambda r: (r["j"] >= F.col("item_at")) & (r["j"] < F.col("item_at") + F.col("size")))
    needed = wrong + 1
    nearest = F.concat(F.slice(before, F.greatest(F.size(before) - needed, F.lit(0)) + 1, needed), between, F.slice(behind, F.lit(1), needed))
    probes = sure.select(*place, F.explode(nearest).alias("r")).select(*place, F.col("r.word").alias("word"))
    return plain.unionByName(unsure), probes


def _word(seed: Column, offset: Column, word: Column) -> Column:
    return F.xxhash64(seed, offset, word)


def benchmark_overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    masks: tuple[str, ...] = MASKS,
    similarity: float = SIMILARITY,
    window: int = WINDOW,
    max_seeds: int = MAX_SEEDS,
    shared: int = SHARED,
) -> DataFrame:
    """``(doc_id, doc_key, item_id, position, matched, compared)`` per leaked item.

    An item leaks into a document if, in the alignment that some hit fixes, at
    least ``similarity`` of the words agree over some ``window`` consecutive
    words of the item (over all of it, if it is shorter). ``position`` is the
    document word under the item's first word (negative if the copy lacks the
    item's start), of the best alignment; ``matched`` of ``compared`` words
    agree there in the best window.

    Words are lower-cased runs of letters and digits; white space and
    punctuation don't matter. Texts without words, as null ones, never match.
    No copy of an item of up to 20 words is missed at the default settings, so
    an item of one word leaks into every document with that word. ``masks`` are
    for items of all sizes, ``SHORT_MASKS`` come on top; a document is hashed
    by those masks only that some item uses. Rows that share id
    and text are one document (``doc_key`` is a hash of the text, so texts
    that share an id stay apart); repeated items give one row each per item
    id. Null ids are kept as ids. Empty tables give an empty result. ``shared``
    and ``max_seeds`` change how much is joined at once, not what is found.
    """
    d = pick(docs, doc_id=id_col, text=text_col).select(
        "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("doc_key"), word_hashes(F.col("text")).alias("words")
    )
    items = (
        pick(benchmark, item_id=item_col, text=item_text_col)
        .select("item_id", word_hashes(F.col("text")).alias("words"))
        .distinct()
        .withColumn("item_key", F.xxhash64(F.col("item_id").cast("string"), "words"))
    )
    every = [*masks, *SHORT_MASKS]
    seeds = _item_seeds(items, every, dict(enumerate(SHORT_MASKS.values(), len(masks))))
    counts = {r["mask"]: r["count"] for r in seeds.groupBy("mask").count().collect()}  # one row per mask
    seeds = stage(seeds.select("mask", "seed", "item_key", "item_at", F.size("words").alias("n_words"), "words"), "seeds")
    direct, probes = _probes(seeds, every, shared, similarity, window)
    direct, probes = stage(direct, "seed-places"), stage(probes, "seed-words")
    plain, extra = direct.count(), probes.count()
    blocks, word_blocks = max(1, -(-plain // max_seeds)), -(-extra // max_seeds)
    doc_seeds = _doc_seeds(d, every, sorted(counts) or [0])

    def aligned(rows: DataFrame) -> DataFrame:
        begin = F.col("at") - F.col("item_at")
        skipped = F.greatest(-begin, F.lit(0))
        theirs = F.slice("words", F.greatest(begin, F.lit(0)) + 1, F.col("n_words") - skipped)
        return rows.select("doc_id", "doc_key", "item_key", begin.alias("position"), theirs.alias("theirs"))

    def hits_of(block: int) -> DataFrame:
        part = direct.where(F.pmod("item_key", F.lit(blocks)) == block)  # at most about max_seeds rows
        return aligned(doc_seeds.join(F.broadcast(part), "seed"))

    def word_hits_of(block: int) -> DataFrame:
        part = probes.where(F.pmod("item_key", F.lit(word_blocks)) == block)  # at most about max_seeds rows
        offsets = F.sequence(F.greatest(-F.col("at"), F.lit(1 - window)), F.least(F.size("words") - 1 - F.col("at"), F.lit(window - 1)))
        some = doc_seeds.join(F.broadcast(part.select("seed").distinct()), "seed")
        around = some.select("*", F.explode(offsets).alias("o")).withColumn(
            "word", _word(F.col("seed"), F.col("o"), F.get("words", F.col("at") + F.col("o")))
        )
        return aligned(around.join(F.broadcast(part.drop("seed")), "word"))

    each = [*map(hits_of, range(blocks)), *map(word_hits_of, range(word_blocks))]
    hits = reduce(DataFrame.unionByName, each)
    alignments = hits.groupBy("doc_id", "doc_key", "item_key", "position").agg(F.first("theirs").alias("theirs"))
    own = items.select("item_key", "item_id", F.col("words").alias("own"))
    span = F.least(F.size("own"), F.lit(window))
    agree = F.transform(
        F.col("own"),
        lambda w, i: F.coalesce((F.get("theirs", i - F.greatest(-F.col("position"), F.lit(0))) == w).cast("int"), F.lit(0)),
    )
    totals = F.transform(
        F.sequence(F.lit(1), F.size("own") - span + 1),
        lambda s: F.aggregate(F.slice("agree", s, span), F.lit(0), lambda x, y: x + y),
    )
    scored = (
        alignments.join(own, "item_key")
        .withColumn("agree", agree)
        .withColumn("matched", F.array_max(totals))
        .withColumn("compared", span)
        .where(F.col("matched") >= F.col("compared") * F.lit(similarity))
    )
    best = F.max(F.struct("matched", -F.col("position")))
    return (
        scored.groupBy("doc_id", "doc_key", "item_id")
        .agg(best.alias("best"), F.first("compared").alias("compared"))
        .select("doc_id", "doc_key", "item_id", (-F.col("best.col2")).alias("position"), "best.matched", "compared")
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` into which no benchmark item leaks, all columns as they were."""
    leaks = benchmark_overlaps(docs, benchmark, id_col, text_col, **settings)
    leaked = leaks.select(F.col("doc_id").alias("_leak_id"), F.col("doc_key").alias("_leak_key")).distinct()
    plain, private = with_keys(docs, _id=id_col, _text=text_col)
    same = F.col("_id").eqNullSafe(F.col("_leak_id")) & (
        F.xxhash64(F.coalesce("_text", F.lit(""))) == F.col("_leak_key")
    )
    return restore(plain.join(leaked, same, "left_anti"), private, docs)
