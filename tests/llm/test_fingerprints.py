import hashlib
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tablelens.llm.fingerprints import (
    containment,
    containment_of_pairs,
    document_sketches,
    edited_pairs,
    from_text,
    likeness,
    merge_sketches,
    probe,
    sketch,
    to_text,
)
from tests.llm.test_simhash import some_texts

LIMIT = 2**62


def shingles_of(text, size=5):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute_sketch(text, size=5):
    """All hashes of a text with at most 64 distinct shingles, else those below a quarter of the range."""
    hashes = {xxhash.xxh64_intdigest(s.encode()) for s in shingles_of(text, size)}
    return sorted(hashes if len(hashes) <= 64 else [h for h in hashes if h < LIMIT])


def brute_text(text):
    return ("=" if 0 < len(shingles_of(text)) <= 64 else "") + "".join(f"{h:016x}" for h in brute_sketch(text))


def brute_likeness(x, y):
    a, b = (set(brute_sketch(t)) for t in (x, y))
    if max(len(shingles_of(x)), len(shingles_of(y))) > 64:
        a, b = ({h for h in s if h < LIMIT} for s in (a, b))
    return len(a & b) / len(a | b) if a | b else 1.0


def brute_rows(pairs):
    order = sorted(((i is not None, i or 0, t or "") for i, t in pairs))
    order = [(i if known else None, t) for known, i, t in order]
    out = []
    for k, (i, t) in enumerate(order):
        n = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        e = t[: len(t) - half] + n[:half]
        near = [round(brute_likeness(t, x), 12) for x in (e, n)]
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), brute_text(t), brute_text(e), *near))
    return out


def got_rows(df):
    return [(*r[:5], round(r[5], 12), round(r[6], 12)) for r in df.collect()]


def test_edited_pairs_match_brute_force(docs, clashing):
    texts = some_texts(90)
    texts[4], texts[5], texts[6], texts[7] = None, "", "é" * 41 + " ünï", "one 😀 two"
    pairs = [(i * 7 % 91, t) for i, t in enumerate(texts)]
    pairs += [(12, "same id, other text"), (12, "same id, other text"), (None, "no id"), (None, "none either")]
    want = sorted(map(str, brute_rows(pairs)))
    for pieces in (1, 5, 64):
        assert sorted(map(str, got_rows(edited_pairs(clashing(docs(pairs)).repartition(4), pieces=pieces)))) == want


def test_single_document_follows_itself(docs):
    got = got_rows(edited_pairs(docs([(5, "abcd")])))
    assert got == brute_rows([(5, "abcd")])
    assert edited_pairs(docs([])).collect() == []


def test_string_ids(spark):
    pairs = [("b", "x y z"), ("a", "p q"), ("ä", "r s t u v w")]
    got = edited_pairs(spark.createDataFrame(pairs, "doc_id string, text string")).collect()
    want = {i: hashlib.sha256(e.encode()).hexdigest() for i, e in (("a", "p x"[:1] + " x"), ("b", "x y" + "r "), ("ä", "r s t " + "p q"))}
    assert {r.doc_id: r.edited_sha256 for r in got} == want


def test_many_rows_of_one_id_go_to_several_tasks(docs):
    """Null ids, or one repeated id, are cut between their texts; results stay those of the whole order."""
    rng = random.Random(8)
    words = "stone river house green light".split()
    for one in (None, 4):
        pairs = [(one, " ".join(rng.choices(words, k=rng.randint(1, 9)))) for _ in range(3000)] + [(i, f"other {i}") for i in range(9)]
        made = edited_pairs(docs(pairs).repartition(3), pieces=24)
        tasks = made.select(F.spark_partition_id().alias("p"), "doc_id").where("doc_id IS NULL" if one is None else "doc_id = 4")
        sizes = [r["count"] for r in tasks.groupBy("p").count().collect()]
        assert len(sizes) >= 4 and max(sizes) < 1800
        assert sorted(map(str, got_rows(made))) == sorted(map(str, brute_rows(pairs)))


def test_sketch_keeps_the_fraction_and_long_texts():
    words = [f"w{i}" for i in range(20_000)]
    s = sketch(" ".join(words))
    assert abs(len(s.hashes) / 19_996 - 0.25) < 0.02 and not s.whole
    assert (np.diff(s.hashes.astype(object)) > 0).all()
    again = from_text(to_text(s))
    assert (again.hashes == s.hashes).all() and not again.whole
    assert likeness(s, s) == 1.0 and likeness(sketch(""), sketch(None)) == 1.0 and likeness(s, sketch("")) == 0.0
    for n in (1, 4, 5, 68, 69):
        short = sketch(" ".join(words[:n]))
        assert short.whole == (n <= 68) and from_text(to_text(short)).whole == short.whole
    assert likeness(sketch("one two"), sketch("one two")) == 1.0 and likeness(sketch("one two"), sketch("one three")) == 0.0


def test_merge_and_containment_between_unequal_documents(docs, spark):
    rng = random.Random(2)
    words = [f"w{rng.randrange(5000)}" for _ in range(6000)]
    long, short, other = " ".join(words), " ".join(words[1000:1400]), " ".join(f"v{i}" for i in range(400))
    fps = document_sketches(docs([(1, long), (2, short), (3, other), (4, ""), (5, None)]))
    s = {r.doc_id: r.fingerprint for r in fps.collect()}
    row = spark.createDataFrame([(s[1], s[2], s[3], "")], "l string, s string, o string, e string")
    c = lambda a, b: containment(F.col(a), F.col(b))
    inside, outside, empty = row.select(c("s", "l"), c("o", "l"), c("e", "l")).first()
    assert inside == 1.0 and outside == 0.0 and empty is None
    merged = merge_sketches(fps.withColumn("g", F.expr("CASE WHEN doc_id <= 3 THEN 1 ELSE 2 END")), ["g"]).collect()
    union = sorted(set(brute_sketch(long)) | set(brute_sketch(short)) | set(brute_sketch(other)))
    assert {r.g: r.fingerprint for r in merged} == {1: "".join(f"{h:016x}" for h in union), 2: ""}


def test_merged_sketches_equal_the_sketch_of_the_union(docs):
    """Whole ones stay whole up to the limit, and lose what is above the threshold beyond it."""
    w = [f"w{i}" for i in range(400)]
    parts = {1: [w[:20], w[10:30]], 2: [w[:40], w[36:69]], 3: [w[:60], w[100:160]], 4: [w[:20], w[:300]], 5: [[], w[:3]]}
    pairs = [(g, " ".join(p)) for g, own in parts.items() for p in own]
    merged = merge_sketches(document_sketches(docs(pairs)), ["doc_id"]).collect()
    for r in merged:
        every = set().union(*(shingles_of(" ".join(p)) for p in parts[r.doc_id]))
        hashes = {xxhash.xxh64_intdigest(x.encode()) for x in every}
        whole = len(hashes) <= 64
        want = sorted(hashes if whole else [h for h in hashes if h < LIMIT])
        assert r.fingerprint == "=" * whole + "".join(f"{h:016x}" for h in want), r.doc_id


def test_containment_by_length(docs, spark):
    """Texts of 1 to 400 words inside a long document: estimates are right or unknown, short texts exact."""
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**6)}" for _ in range(4000)]
    lengths = [1, 2, 3, 4, 5, 6, 8, 10, 15, 20, 40, 60, 68, 69, 80, 120, 200, 400]
    inner = [(n, at) for n in lengths for at in rng.sample(range(3500), 12)]
    pairs = [(0, " ".join(words))] + [(1 + k, " ".join(words[at : at + n])) for k, (n, at) in enumerate(inner)]
    pairs += [(5000, " ".join([*words[5:40], *[f"x{i}" for i in range(35)]]))]
    d = docs(pairs)
    wanted = spark.createDataFrame([(i, 0) for i, _ in pairs[1:]], "inner_id bigint, outer_id bigint")
    got = {r.inner_id: r for r in containment_of_pairs(wanted, d).collect()}
    whole = set(words)
    for k, (n, _) in enumerate(inner):
        r = got[1 + k]
        assert r.exact == (n <= 68)
        # a text of fewer than five words is its own only shingle, which a longer text need not have
        assert r.containment == (1.0 if n >= 5 else 0.0), (n, whole and r)
    held = len(shingles_of(" ".join(words[5:40])))
    assert abs(got[5000].containment - held / len(shingles_of(pairs[-1][1]))) < (1e-12 if got[5000].exact else 0.2)
    s = {r.doc_id: r.fingerprint for r in document_sketches(d).collect()}
    rows = spark.createDataFrame([(i, s[i], s[0]) for i in list(s) if 0 < i < 5000], "i bigint, a string, b string")
    shares = [(r.i, r.c) for r in rows.select("i", containment(F.col("a"), F.col("b")).alias("c")).collect()]
    assert all(c is None or c == (1.0 if inner[i - 1][0] >= 5 else 0.0) for i, c in shares)
    unknown = {n: np.mean([c is None for i, c in shares if inner[i - 1][0] == n]) for n in lengths}
    assert unknown[5] > 0.3 and unknown[400] == 0


def test_probe_of_empty_and_null(spark):
    rows = spark.createDataFrame([("", "a b"), (None, "a b"), (to_text(sketch("a b")), None), (to_text(sketch("A  b")), "a b")], "f string, t string")
    assert [r.p for r in rows.select(probe(F.col("f"), F.col("t")).alias("p")).collect()] == [None, None, 0.0, 1.0]
