import random
from itertools import combinations

import xxhash

from tablelens.llm.graph import connected_components
from tablelens.llm.simhash import covering_masks, keep_one_per_component, links, simhash, simhash_components

WORDS = "the of and stone river green light house walks over under a very old small tree with many birds".split()


def brute_simhash(text, size=3):
    words, word = [], bytearray()
    for byte in (text or "").encode() + b" ":
        if byte == 0x20 or 0x09 <= byte <= 0x0D:
            if word:
                words.append(bytes(word))
            word = bytearray()
        else:
            word.append(byte + 32 if 0x41 <= byte <= 0x5A else byte)
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs, radius):
    """(fingerprint, smallest id) by union-find over all pairs."""
    fps = [brute_simhash(t) for _, t in pairs]
    parent = list(range(len(pairs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(pairs)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= radius:
            parent[root(i)] = root(j)
    out = []
    for i, (doc, _) in enumerate(pairs):
        same = [pairs[k][0] for k in range(len(pairs)) if root(k) == root(i) and pairs[k][0] is not None]
        out.append((doc, f"{fps[i]:016x}", min(same) if same else None))
    return out


def some_texts(n, seed=3):
    rng = random.Random(seed)
    base = [" ".join(rng.choices(WORDS, k=rng.randint(0, 60))) for _ in range(n // 3)]
    out = list(base)
    while len(out) < n:
        words = rng.choice(base).split(" ")
        words[rng.randrange(len(words))] = rng.choice(WORDS)
        out.append(rng.choice([" ", "\t", "\n"]).join(words).upper() if rng.random() < 0.3 else " ".join(words))
    return out


def by_doc(rows):
    return sorted(((r[0], r[1], r[2]) for r in rows), key=str)


def test_fingerprint_matches_brute_force():
    for t in [*some_texts(60), "", " ", None, "One", "one two", "É é\x1cx \x0b y", "a b c", "long " * 40_000]:
        assert simhash(t) % (1 << 64) == brute_simhash(t)


def test_every_pair_within_radius_shares_a_table():
    for radius in (1, 2, 3):
        masks = covering_masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        for bits in combinations(range(64), radius):
            assert any(not any(m >> b & 1 for b in bits) for m in masks)


def test_components_match_brute_force(docs):
    pairs = list(enumerate(some_texts(150)))
    pairs += [(500, None), (501, ""), (502, "   "), (None, pairs[0][1]), (7, "repeated id"), (9, pairs[9][1])]
    got = simhash_components(docs(pairs)).collect()
    assert by_doc(got) == by_doc(brute_components(pairs, 2))


def test_large_buckets_match_brute_force(spark):
    rng = random.Random(5)
    for radius in (1, 2, 3):
        seeds = [rng.getrandbits(64) for _ in range(4)]
        fps = set(seeds)
        for _ in range(300):
            fps.add(rng.choice(sorted(fps)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
        signed = [x - (1 << 64) if x >> 63 else x for x in fps]
        frame = spark.createDataFrame([(x,) for x in signed], "fp bigint")
        labels = []
        for small in (10_000, 2):
            edges = links(frame, radius, small).collect()
            assert all(((e.a ^ e.b) % (1 << 64)).bit_count() <= radius for e in edges)
            parts = connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
            labels.append(sorted(map(tuple, parts)))
        assert labels[0] == labels[1]
        pairs = {(a, b) for a, b in combinations(signed, 2) if ((a ^ b) % (1 << 64)).bit_count() <= radius}
        assert {x for p in pairs for x in p} == {n for n, _ in labels[0]}


def test_components_of_a_long_chain(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 103), (103, 101), (5, 5)]
    random.Random(1).shuffle(chain)
    got = dict(map(tuple, connected_components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()))
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 103: 100}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_one_document_of_each_component_stays(docs, clashing):
    text = "a small green tree over the river"
    pairs = [(3, text), (1, text.upper()), (2, "another text of its own words"), (2, "another text of its own words"), (None, text)]
    d = clashing(docs(pairs))
    kept = keep_one_per_component(d)
    assert kept.columns == d.columns
    assert sorted((r[0], r[1]) for r in kept.collect()) == [(1, text.upper()), (2, "another text of its own words")]


def test_empty_table(docs):
    assert simhash_components(docs([])).collect() == []
    assert keep_one_per_component(docs([])).collect() == []
