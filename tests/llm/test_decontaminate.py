import random
import re
from itertools import combinations, product

import pytest
from pyspark.sql import functions as F

from tablelens.llm.common import stage
from tablelens.llm.decontaminate import (
    MASKS,
    SHORT_MASKS,
    _item_seeds,
    _probes,
    benchmark_overlaps,
    decontaminated,
    word_hashes,
)

ITEM = "item_id bigint, text string"


def tokens(t):
    return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]


def brute(pairs, items, window=20, similarity=0.8):
    """(doc, item) pairs where some alignment agrees over some window (no seeds)."""
    out = set()
    for i, t in pairs:
        w = tokens(t)
        for k, item in items:
            v = tokens(item)
            if len(v) < 6:
                continue
            for shift in range(-len(v), len(w)):
                agree = [0 <= shift + j < len(w) and w[shift + j] == x for j, x in enumerate(v)]
                span = min(window, len(v))
                if any(sum(agree[s : s + span]) >= similarity * span for s in range(len(v) - span + 1)):
                    out.add((i, k))
    return out


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + rng.choice("aeiou") + rng.choice("klmnop")
    items = [(k, " ".join(word() for _ in range(rng.randint(14, 45)))) for k in range(12)]
    pairs = []
    for i in range(60):
        own = [word() for _ in range(rng.randint(5, 80))]
        if rng.random() < 0.5:
            copy = rng.choice(items)[1].split()
            for at in rng.sample(range(len(copy)), int(len(copy) * rng.choice([0, 0.1, 0.2, 0.5]))):
                copy[at] = "other"
            own[len(own) // 2 : len(own) // 2] = [w.upper() + rng.choice(["", ",", ".\n"]) for w in copy]
        pairs.append((i, " ".join(own)))
    return pairs, items


def test_masks_hit_every_allowed_substitution():
    kept = [[i for i, c in enumerate(m) if c == "1"] for m in MASKS]
    for length, changed in ((14, 2), (15, 3), (20, 4)):
        for bad in combinations(range(length), changed):
            assert any(
                all(s + o not in bad for o in offsets)
                for offsets, m in zip(kept, MASKS, strict=True)
                for s in range(length - len(m) + 1)
            )


def test_matches_brute_force(docs, spark, clashing):
    pairs, items = corpus()
    pairs += [(100, None), (101, ""), (102, "short one")]
    bench = spark.createDataFrame([*items, (50, None), (51, ""), (52, "too short")], ITEM)
    want = brute(pairs, items)
    assert len(want) > 10
    for limit in (10**6, 40):  # one block, and many
        got = benchmark_overlaps(clashing(docs(pairs)), bench, max_seeds=limit).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    kept = decontaminated(clashing(docs(pairs)), bench)
    assert kept.columns == clashing(docs(pairs)).columns
    assert sorted(r[0] for r in kept.collect()) == [i for i, _ in pairs if i not in {x for x, _ in want}]


def test_copy_that_starts_before_or_ends_after_the_document(docs, spark):
    item = [f"w{i}" for i in range(40)]
    bench = spark.createDataFrame([(1, " ".join(item))], ITEM)
    d = docs([(1, " ".join(item[12:])), (2, " ".join(item[:25])), (3, " ".join(item[:15])), (None, " ".join(item))])
    got = {r.doc_id: (r.position, r.matched, r.compared) for r in benchmark_overlaps(d, bench).collect()}
    assert got == {1: (-12, 20, 20), 2: (0, 20, 20), None: (0, 20, 20)}
    assert [r.doc_id for r in decontaminated(d, bench).collect()] == [3]


def test_repeated_ids_and_items(docs, spark):
    item = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([(1, item), (1, item), (2, item), (None, item)], ITEM)
    d = docs([(1, item), (1, "a clean text with the same id"), (2, item), (2, item)])
    got = sorted((r.doc_id, str(r.item_id)) for r in benchmark_overlaps(d, bench).collect())
    assert got == [(1, "1"), (1, "2"), (1, "None"), (2, "1"), (2, "2"), (2, "None")]
    assert [r.text for r in decontaminated(d, bench).collect()] == ["a clean text with the same id"]


@pytest.mark.parametrize("empty", ["docs", "items"])
def test_empty_tables(docs, spark, empty):
    d = docs([] if empty == "docs" else [(1, "some words of a text that is long enough")])
    bench = spark.createDataFrame([] if empty == "items" else [(1, "some words of a text that is long enough")], ITEM)
    assert benchmark_overlaps(d, bench).collect() == []
    assert decontaminated(d, bench).count() == d.count()


def test_masks_of_short_items_hit_every_allowed_substitution():
    for length in range(1, 21):
        own = [m for m, (least, most) in SHORT_MASKS.items() if least <= length <= most]
        placed = [{s + i for i, c in enumerate(m) if c == "1"} for m in (*MASKS, *own) for s in range(length - len(m) + 1)]
        for bad in combinations(range(length), length - -(-4 * length // 5)):
            assert any(p.isdisjoint(bad) for p in placed)


def test_short_items_match_brute_force(docs, spark):
    """Every substitution that the similarity allows, and one more, for items of 1 to 13 words."""
    items = [(n, " ".join(f"i{n}w{k}" for k in range(n))) for n in range(1, 14)]
    items.append((20, "\u4e2d\u6587\u6ca1\u6709\u7a7a\u683c"))
    pairs = [(0, f"before {items[-1][1]}, after")]
    for n, item in items[:-1]:
        allowed = n - -(-4 * n // 5)
        for changed in range(allowed + 2):
            for bad in combinations(range(n), min(changed, n)):
                copy = ["other" if k in bad else w for k, w in enumerate(item.split())]
                pairs.append((len(pairs), " ".join(["x", *copy, "y"])))
        pairs += [(len(pairs), " ".join(item.split()[1:])), (len(pairs) + 1, " ".join(item.split()[:-1]))]
    want = set()
    for (i, t), (k, item) in product(pairs, items):
        w, v = tokens(t), tokens(item)
        for shift in range(-len(v), len(w)):
            if sum(0 <= shift + j < len(w) and w[shift + j] == x for j, x in enumerate(v)) >= 0.8 * len(v):
                want.add((i, k))
    got = benchmark_overlaps(docs(pairs), spark.createDataFrame(items, ITEM)).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    assert {k for _, k in want} == {k for k, _ in items} and len({i for i, _ in want}) < len(pairs)


def shared_phrases(seed=3):
    """Items that begin with one sentence, end with one, or differ from each other in a word or two."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + rng.choice("aeiou") + rng.choice("klmnop")
    phrase = [word() for _ in range(12)]
    template = [word() for _ in range(18)]
    items = [(k, " ".join([*phrase, *[word() for _ in range(rng.randint(0, 25))]])) for k in range(30)]
    items += [(100 + k, " ".join([*[word() for _ in range(rng.randint(1, 25))], *phrase])) for k in range(30)]
    for k in range(20):
        own = list(template)
        for at in rng.sample(range(18), rng.randint(0, 3)):
            own[at] = word()
        items.append((200 + k, " ".join(own)))
    pairs = []
    for i in range(80):
        own = [word() for _ in range(rng.randint(0, 30))]
        kind = rng.random()
        if kind < 0.4:  # the shared sentence alone
            own[len(own) // 2 : len(own) // 2] = phrase
        else:  # a copy with substitutions up to and beyond what counts
            copy = rng.choice(items)[1].split()
            for at in rng.sample(range(len(copy)), int(len(copy) * rng.choice([0, 0.1, 0.15, 0.2, 0.25]))):
                copy[at] = "other"
            own[len(own) // 3 : len(own) // 3] = copy
        pairs.append((i, " ".join(own)))
    return pairs, items


@pytest.mark.parametrize("shared", [0, 2, 8, 1000])
def test_shared_phrases_lose_no_item(docs, spark, shared):
    pairs, items = shared_phrases()
    want = brute(pairs, items)
    got = benchmark_overlaps(docs(pairs), spark.createDataFrame(items, ITEM), shared=shared, max_seeds=700 if shared == 2 else 10**6).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want) > 60


def test_a_shared_sentence_adds_no_alignments(docs, spark):
    """Documents that hold the sentence meet the items that begin with it only where more of them agrees."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=5))
    phrase = " ".join(word() for _ in range(12))
    items = spark.createDataFrame([(k, " ".join([phrase, *[word() for _ in range(20)]])) for k in range(400)], ITEM)
    pairs = [(i, " ".join([*[word() for _ in range(20)], phrase, *[word() for _ in range(20)]])) for i in range(50)]
    every = stage(_item_seeds_of(items), "test-seeds")
    plain, probes = _probes(every, [*MASKS, *SHORT_MASKS], 8, 0.8, 20)
    most = plain.groupBy("seed").count().agg({"count": "max"}).first()[0]
    assert most <= 8 and probes.groupBy("word").count().agg({"count": "max"}).first()[0] <= 8
    assert benchmark_overlaps(docs(pairs), items).collect() == []


def _item_seeds_of(items):
    own = items.select("item_id", word_hashes(items["text"]).alias("words")).withColumn("item_key", F.col("item_id"))
    seeds = _item_seeds(own, [*MASKS, *SHORT_MASKS], dict(enumerate(SHORT_MASKS.values(), len(MASKS))))
    return seeds.select("mask", "seed", "item_key", "item_at", F.size("words").alias("n_words"), "words")
