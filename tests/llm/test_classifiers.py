import random
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablelens.llm.langid import Shared, Spectrum, fit_languages, identify_languages, training_sample
from tablelens.llm.quality import keep_good, quality_posteriors, shape
from tablelens.llm.queries import op6_toxicity, op7_language, op8_quality, quality_scores
from tablelens.llm.samples import labelled_sample
from tablelens.llm.toxicity import (
    IDENTITY_TERMS,
    _counterfactual_products,
    features_of,
    fit_toxicity,
    sentences_of,
    swaps,
    toxicity,
    words_of,
)

SF = "/root/testdata/sf0.01"
LABELS = "doc_id bigint, quality int, toxic int"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


# ------------------------------------------------------------------- samples


def sampled(d, labels, limit):
    return sorted(map(tuple, labelled_sample(d, labels, "toxic", limit).collect()))


def test_sample_takes_labels_by_hash_of_the_id(docs, spark):
    d, labels = docs([(i, f"t{i}") for i in range(90)]), spark.createDataFrame([(i, 1, i % 2) for i in range(90)], LABELS)
    ranked = labels.orderBy(F.xxhash64(F.col("doc_id").cast("string"))).limit(20).collect()
    assert sampled(d.repartition(5), labels.repartition(7), 20) == sorted((f"t{r.doc_id}", r.toxic) for r in ranked)
    assert sampled(d, labels, 500) == sorted((f"t{i}", i % 2) for i in range(90))
    assert sampled(d.limit(0), labels, 20) == sampled(d, labels.limit(0), 20) == []


@pytest.mark.parametrize("one_id", [7, 11, 13, 23])
def test_one_id_for_all_texts_of_a_label(docs, spark, one_id):
    """Its texts are rows like the others: no pair of text and label row is made twice, none is cut by chance."""
    pairs = [(1000 + i, f"calm {i}") for i in range(300)] + [(one_id, f"vile {i}") for i in range(300)]
    labels = spark.createDataFrame([(i, 1, int(i == one_id)) for i, _ in pairs], LABELS)  # 300 equal label rows
    every = sorted((t, int(i == one_id)) for i, t in pairs)
    assert sampled(docs(pairs), labels, 600) == every
    some = sampled(docs(pairs).repartition(3), labels.repartition(5), 400)
    rows = spark.createDataFrame([(i, t, int(i == one_id)) for i, t in pairs], "i bigint, t string, l int")
    ranked = rows.orderBy(F.xxhash64(F.col("i").cast("string"), "t", "l")).limit(400).collect()
    assert some == sorted((r.t, r.l) for r in ranked) and 150 < sum(k for _, k in some) < 250


def test_copies_and_contrary_labels_in_a_sample(docs, spark):
    d = docs([(1, "a")] * 40 + [(2, "b"), (3, None), (None, "c")])
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (1, 1, 1), (2, 1, 1), (3, 1, 0), (4, 1, 1), (None, 1, 1), (2, 1, None)], LABELS)
    assert sampled(d, labels, 100) == sorted([("a", 0)] * 40 + [("a", 1)] * 40 + [("b", 1), ("", 0)])
    few = sampled(d.repartition(6), labels, 10)
    assert len(few) == 10 and few == sampled(d.repartition(2), labels.repartition(3), 10)


# ------------------------------------------------------------------ toxicity


def test_toxicity_on_held_out_rows(spark, tables):
    d, labels = tables
    rows = op6_toxicity(spark, SF).join(labels, "doc_id", "left").collect()
    assert len(rows) == d.count() and all(r.held_out == (crc(r.doc_id, 5) == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.toxic is not None]
    right = lambda k: np.mean([r.predicted == k for r in held if r.toxic == k])
    assert right(0) > 0.9 and np.mean([r.predicted == r.toxic for r in held]) > 0.85


def test_held_out_labels_and_other_columns_are_never_read(docs, spark):
    pairs = [(i, ("vile scum " if i % 2 else "calm day ") + f"text {i % 7}") for i in range(200)]
    labels = [(i, 1, i % 2) for i in range(200)]
    flipped = [(i, 1, 1 - t if crc(i, 5) == 0 else t) for i, _, t in labels]
    a, b = (
        toxicity(docs(pairs, sources=[s] * 200), spark.createDataFrame(x, LABELS)).orderBy("doc_id").collect()
        for x, s in ((labels, "a"), (flipped, "b"))
    )
    assert a == b and all(r.predicted == r.doc_id % 2 for r in a)


def group_mentions(n=400):
    """Toxic texts mention one group more often than another; neutral mentions are of all groups."""
    rng = random.Random(9)
    fill = lambda: " ".join(rng.choices("we saw some at the market today and they were there with us".split(), k=6))
    pairs, labels = [], []
    for i in range(n):
        toxic = int(rng.random() < 0.4)
        group = rng.choice(["muslims"] * 8 + ["christians"]) if toxic else rng.choice(["muslims"] + ["christians"] * 6 + ["jews"] * 3)
        insult = rng.choice(["scum", "trash"]) if toxic and rng.random() < 0.6 else ""
        pairs.append((i, f"{fill()} {group} {insult} {fill()}."))
        labels.append((i, 1, toxic))
    return pairs, labels


def test_counterfactual_penalty_lowers_false_positives_on_neutral_mentions(docs, spark):
    pairs, labels = group_mentions()
    neutral = [f"the {g} had a market today" for g in ("muslims", "christians", "jews", "hindus")]
    gaps = {}
    for weight in (0.0, 5.0):
        model = fit_toxicity(docs(pairs), spark.createDataFrame(labels, LABELS), counterfactual=weight)
        score = model.scorer()
        gaps[weight] = max(map(score, neutral)) - min(map(score, neutral))
        assert score("they are scum and trash") > 0.5
        if weight:
            assert all(score(t) < 0.5 for t in neutral)
    assert gaps[5.0] < 0.3 * gaps[0.0]


def test_counterfactual_pairs_are_summed_in_the_tasks(docs, spark):
    """A sample with 60,000 pairs: the driver holds no row for each, and the penalty is that of all pairs."""
    pairs, labels = group_mentions()
    terms = ("muslims", "christians", "jews", "hindus")
    pairs[0] = (0, " ".join(f"We saw the {terms[i % 4]} there." for i in range(20_000)))
    d, known = docs(pairs), spark.createDataFrame(labels, LABELS)
    tracemalloc.start()
    model = fit_toxicity(d, known, identity_terms=[terms])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20
    number = {f: i for i, f in enumerate(model.features)}
    row = lambda words: np.array([float(f in features_of(words)) for f in number])
    rows_of = lambda t: [row(h) - row(o) for h in map(words_of, t) for o in swaps(h, [terms])]
    long = np.array(rows_of(sentences_of(pairs[0][1])[:4]))  # then they repeat
    short = np.array([c for _, t in pairs[1:] for c in rows_of(sentences_of(t))])
    products = 5_000 * long.T @ long + short.T @ short
    assert (abs(long).sum(axis=1) > 0).all() and (abs(short).sum(axis=1) > 0).all()
    got, n = _counterfactual_products(d.select("text"), number, [terms])
    assert n == 60_000 + len(short) and np.array_equal(got, products)


def plain_toxicity(pairs, labels, groups, most=600, ridge=0.3, weight=1.0):
    """``{doc_id: score}``, features and weights from plain counts and gradient steps, without the operator's own fit."""
    known = {i: t for i, _, t in labels}
    rows = [(features_of(words_of(t)), known[i]) for i, t in pairs if i in known and crc(i, 5)]
    y = np.array([k for _, k in rows], dtype=float)
    toxic, n = y.sum(), len(rows)
    seen, hits = defaultdict(int), defaultdict(int)
    for some, k in rows:
        for f in some:
            seen[f] += 1
            hits[f] += k

    def cell(a, b):
        return a * np.log(a / b) if a else 0.0

    g = {f: 2 * (cell(hits[f], m * toxic / n) + cell(m - hits[f], m * (n - toxic) / n)) for f, m in seen.items() if m >= 3}
    features = sorted(g, key=lambda f: (-round(g[f], 9), f))[:most]
    vector = lambda some: np.array([float(f in some) for f in features])
    x = np.array([[*vector(some), 1.0] for some, _ in rows])
    changes = []
    for i, t in pairs:
        for here in map(words_of, sentences_of(t) if i in known and crc(i, 5) else []):
            changes += [vector(features_of(here)) - vector(features_of(other)) for other in swaps(here, groups)]
    changes = np.array([[*c, 0.0] for c in changes if c.any()])
    each = np.where(y > 0, n / (2 * toxic), n / (2 * (n - toxic)))
    price = np.array([ridge] * len(features) + [1e-6])
    pull = weight * n / max(len(changes), 1) * (changes.T @ changes if len(changes) else np.zeros((len(price), len(price))))

    def slope(w):
        return x.T @ (each * (1 / (1 + np.exp(-x @ w)) - y)) + price * w + pull @ w

    step = 1 / (np.linalg.norm((x.T * each) @ x / 4 + pull + np.diag(price), 2))
    w = ahead = np.zeros(len(price))
    for k in range(20_000):
        new = ahead - step * slope(ahead)
        if (ahead - new) @ (new - w) > 0:  # beyond the valley: begin anew
            ahead, w, momentum = new, new, 0
        else:
            momentum = k / (k + 3)
            ahead, w = new + momentum * (new - w), new
        if np.abs(slope(w)).max() < 1e-7:
            break
    assert np.abs(slope(w)).max() < 1e-4
    return features, {i: 1 / (1 + np.exp(-(vector(features_of(words_of(t or ""))) @ w[:-1] + w[-1]))) for i, t in pairs}


@pytest.mark.parametrize("most", [600, 25])
def test_whole_result_matches_a_plain_fit(docs, spark, most):
    """With identity terms in the texts, so the penalty has pairs; ties at the last feature are settled by name."""
    pairs, labels = group_mentions()
    pairs += [(900, None), (901, ""), (902, "The muslims saw trash. The jews were there!\nSome scum.")]
    d, known = docs(pairs), spark.createDataFrame(labels, LABELS)
    features, want = plain_toxicity(pairs, labels, IDENTITY_TERMS, most)
    got = {r.doc_id: r for r in toxicity(d, known, max_features=most).collect()}
    model = fit_toxicity(d, known, learn=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0, max_features=most)
    assert sorted(model.features) == sorted(features) and got.keys() == want.keys()
    assert all(abs(got[i].score - want[i]) < 1e-4 for i in want)
    assert all(got[i].predicted == int(want[i] >= 0.5) for i in want if abs(want[i] - 0.5) > 1e-4)
    assert all(got[i].held_out == (crc(i, 5) == 0) for i in want)
    without = plain_toxicity(pairs, labels, IDENTITY_TERMS, most, weight=0.0)[1]
    assert max(abs(without[i] - want[i]) for i in want) > 0.05  # the penalty is no trifle here


def test_swaps_turn_through_a_group():
    assert [sorted(s) for s in swaps(words_of("The women smiled"), [("women", "men", "girls")])] == [
        ["men", "smiled", "the"],
        ["girls", "smiled", "the"],
    ]
    assert list(swaps({"nobody"}, [("women", "men")])) == []


def test_toxicity_edges(docs, spark, clashing):
    d = clashing(docs([(1, "vile scum"), (1, "vile scum"), (2, None), (None, "calm"), (4, "x " * 200_000)]))
    one_kind = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (None, 1, 1), (4, 1, None)], LABELS)
    for labels in (one_kind, spark.createDataFrame([], LABELS)):
        rows = toxicity(d, labels).collect()
        assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
        assert [r.held_out for r in rows if r.doc_id is None] == [True]
    assert toxicity(docs([]), one_kind).collect() == []


# ------------------------------------------------------------------- quality


def test_quality_keeps_good_and_rejects_bad(spark, tables):
    d, labels = tables
    rows = op8_quality(spark, SF).join(labels, "doc_id").collect()
    assert len(rows) == labels.count()
    label = rows[0].__fields__.index("toxic") - 1  # the labels' quality; the posterior has that name, too
    by = {k: np.mean([r.keep for r in rows if r[label] == k]) for k in (0, 1)}
    assert by[1] > 0.98 and by[0] < 0.1


def brute_strengths(hosts, paths, rate):
    """Prior strengths of hosts around the global rate, and of paths around their own host's."""
    n = sum(map(len, hosts.values()))
    spread = sum(len(g) * (np.mean(g) - rate) ** 2 for g in hosts.values())
    true = (spread - (len(hosts) - 1) * rate * (1 - rate)) / (n - sum(len(g) ** 2 for g in hosts.values()) / n)
    host = min(max(rate * (1 - rate) / true - 1, 2.0), 1e6) if len(hosts) > 1 and true > 0 else 1e6
    spread = expected = room = each = 0.0
    for h, g in hosts.items():
        own = [q for (of, _), q in paths.items() if of == h]
        m = np.mean(g)
        spread += sum(len(q) * (np.mean(q) - m) ** 2 for q in own)
        expected += (len(own) - 1) * m * (1 - m)
        room += len(g) - sum(len(q) ** 2 for q in own) / len(g)
        each += len(g) * m * (1 - m)
    true = (spread - expected) / room if room > 1e-9 else 0.0
    return host, (min(max(each / n / true - 1, 2.0), 1e6) if true > 0 else 1e6)


@pytest.fixture
def given_evidence(monkeypatch):
    """Texts that are numbers are the classifier's own probability."""

    def evidence(docs, model):
        return docs.select("doc_id", "doc_key", "host", "path", F.col("text").cast("double").alias("p"))

    monkeypatch.setattr("tablelens.llm.quality.own_evidence", evidence)


@pytest.mark.parametrize("differ", ["hosts", "paths", "both", "neither"])
def test_priors_match_brute_force_whatever_differs(docs, spark, given_evidence, differ):
    rng = random.Random(len(differ))
    rows = []
    for i in range(3000):
        h, q = rng.randrange(6), rng.randrange(4)
        base = 0.5 + (0.07 * (h - 2.5) if differ in ("hosts", "both") else 0) + (0.12 * (q - 1.5) if differ in ("paths", "both") else 0)
        rows.append((i, str(round(float(rng.random() < base) * 0.98 + 0.01, 2)), f"h{h}", f"h{h}/{q}"))
    d = spark.createDataFrame(rows, "doc_id bigint, text string, host string, path string")
    out = quality_posteriors(d, spark.createDataFrame([], LABELS), F.col("host"), F.col("path")).collect()
    hosts, paths = defaultdict(list), defaultdict(list)
    for r in out:
        hosts[r.host].append(r.p)
        paths[(r.host, r.path)].append(r.p)
    rate = np.mean([r.p for r in out])
    hp, pp = brute_strengths(hosts, paths, rate)
    if differ == "hosts":
        assert pp > 300  # measured around the global rate it would be some 20
    if differ == "paths":
        assert pp < 60
    for r in out[:400]:
        h, q = hosts[r.host], paths[(r.host, r.path)]
        host_rate = (sum(h) - r.p + hp * rate) / (len(h) - 1 + hp)
        assert abs(r.host_rate - host_rate) < 1e-6
        assert abs(r.path_rate - (sum(q) - r.p + pp * host_rate) / (len(q) - 1 + pp)) < 1e-6


def test_posteriors_turn_decisions(docs, spark, given_evidence):
    """Weak evidence follows the path, then the host; strong evidence stands."""
    rows = [(i, "0.02" if i % 20 else "0.9", "bad", "bad/a") for i in range(400)]
    rows += [(1000 + i, "0.97" if i % 20 else "0.1", "good", "good/a") for i in range(400)]
    rows += [(2000, "0.6", "bad", "bad/a"), (2001, "0.4", "good", "good/a"), (2002, "0.6", "bad", "bad/new"), (2003, "0.9999", "bad", "bad/a"), (2004, "0.6", "new", "new/a")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, host string, path string")
    out = {r.doc_id: r for r in quality_posteriors(d, spark.createDataFrame([], LABELS), F.col("host"), F.col("path")).collect()}
    assert [out[k].keep for k in (2000, 2001, 2002, 2003, 2004)] == [0, 1, 0, 1, 1]
    turned = [r for r in out.values() if r.keep != int(r.p >= 0.5)]
    assert len(turned) >= 3
    kept = keep_good(d, quality_posteriors(d, spark.createDataFrame([], LABELS), F.col("host"), F.col("path")))
    assert {2000, 2002}.isdisjoint(r.doc_id for r in kept.collect())


def test_posteriors_match_brute_force(docs, spark, tables):
    labels = tables[1]
    some = tables[0].limit(300).withColumn("source", F.expr("CASE WHEN doc_id % 9 = 0 THEN NULL ELSE source END"))
    rows = quality_scores(some, labels).collect()
    assert len(rows) == some.count()
    p = {(r.host, r.path, r.doc_id): r.p for r in rows}
    total, n = sum(p.values()), len(p)
    rate = min(max(total / n, 1e-4), 1 - 1e-4)

    hosts, paths = defaultdict(list), defaultdict(list)
    for (host, path, _), v in p.items():
        hosts[host].append(v)
        paths[(host, path)].append(v)
    hp, pp = brute_strengths(hosts, paths, rate)
    for r in rows:
        h, q = hosts[r.host], paths[(r.host, r.path)]
        host_rate = (sum(h) - r.p + hp * rate) / (len(h) - 1 + hp)
        path_rate = (sum(q) - r.p + pp * host_rate) / (len(q) - 1 + pp)
        logit = lambda x: np.log(x / (1 - x))
        odds = logit(r.p) + logit(path_rate) - logit(rate)
        assert abs(r.path_rate - path_rate) < 1e-9 and abs(r.quality - 1 / (1 + np.exp(-odds))) < 1e-9
        assert r.keep == int(r.quality >= 0.5)


def test_sparse_sites_shrink_and_full_sites_move(docs, spark):
    good = "The stone house stood over the quiet river, and people walked there.\nIt was a long day."
    bad = "%%% $$$ 1111 ### " * 12
    rng = random.Random(2)
    text = lambda k: bad + str(rng.random()) if k else good + " Then " + " ".join(rng.sample(good.split(), 6))
    pairs = [(i, text(i % 2 if i < 200 else i < 290)) for i in range(400)]
    sources = ["mixed" if i < 200 else "spam" if i < 300 else "fine" for i in range(400)]
    sources[399] = "tiny"
    labels = spark.createDataFrame([(i, int("%" not in t), 0) for i, t in pairs[:200]], LABELS)
    out = quality_posteriors(docs(pairs, sources=sources), labels, F.col("source"), F.col("lang"))
    r = {x.doc_id: x for x in out.collect()}
    assert r[295].path_rate < r[399].path_rate < r[350].path_rate
    assert r[295].keep == 1 and r[210].keep == 0  # own evidence is strong enough to stand


def test_quality_edges(docs, spark, clashing):
    d = clashing(docs([(1, "a text"), (1, "a text"), (2, None), (None, ""), (3, "w " * 100_000)]))
    for labels in ([(1, 1, 0), (2, None, 0), (None, 0, 0)], []):
        scores = quality_scores(d, spark.createDataFrame(labels, LABELS))
        assert scores.count() == 5 and scores.where("quality BETWEEN 0 AND 1").count() == 5
        assert keep_good(d, scores).columns == d.columns
    empty = docs([])
    assert keep_good(empty, quality_scores(empty, spark.createDataFrame([], LABELS))).collect() == []
    assert shape("") == [0.0] * 11 and len(shape("\x00 é")) == 11


# ------------------------------------------------------------------ language


def test_languages_of_held_out_rows(spark, tables):
    truth = {r.doc_id: r.lang for r in tables[0].select("doc_id", "lang").collect()}
    rows = op7_language(spark, SF).collect()
    assert len(rows) == len(truth) and all(r.held_out == (crc(r.doc_id, 3) == 1) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]) > 0.97


def test_spectrum_is_the_set_of_ngrams():
    letters = "abcé"
    s = Spectrum(letters)
    number = lambda c: letters.index(c) + 1 if c in letters else 0
    for text in ["", "a", "ab", "Abcé! ab", "é" * 10, "b-a\nc" * 3, "😀ab"]:
        t = [number(c) for c in text.lower()]
        want = {*t} | {5 + a * 5 + b for a, b in zip(t, t[1:])} | {30 + (a * 5 + b) * 5 + c for a, b, c in zip(t, t[1:], t[2:])}
        assert set(s.grams(text).tolist()) == want


def test_kernel_is_exact(docs, spark, tables):
    d = tables[0].select("doc_id", "text", "lang")
    model = fit_languages(d, landmarks=16, per_language=20)
    s = Spectrum(model.landmarks.letters)
    texts = [r.text for r in d.limit(20).collect()]
    (tile,) = model.landmarks.tiles
    marks = [set(tile.vocabulary[tile.presence[:, j] > 0].tolist()) for j in range(16)]
    for t, row in zip(texts, model.landmarks.kernel()(texts), strict=True):
        own = set(s.grams(t).tolist())
        assert np.allclose(row, [len(own & m) / np.sqrt(len(own) * len(m)) for m in marks], atol=1e-6)


def test_tiles_of_landmarks_change_nothing(tables, monkeypatch):
    d = tables[0].select("doc_id", "text", "lang")
    texts = [r.text for r in d.limit(30).collect()]
    one = fit_languages(d, landmarks=20, per_language=10)
    monkeypatch.setattr("tablelens.llm.langid.TILE", 7)
    many = fit_languages(d.repartition(5), landmarks=20, per_language=10)
    assert [len(t.norms) for t in many.landmarks.tiles] == [7, 7, 6]
    assert np.allclose(one.landmarks.kernel()(texts), many.landmarks.kernel()(texts), atol=1e-6)
    assert np.allclose(one.coefficients, many.coefficients, atol=1e-3)


def test_fit_equals_plain_kernel_ridge_on_landmarks(tables):
    """The whole fit with sets and dense matrices."""
    d = tables[0].select("doc_id", "text", "lang")
    model = fit_languages(d, landmarks=12, per_language=15)
    rows = training_sample(d, 3, 1, 15).collect()
    rows.sort(key=lambda r: (r.nth, r.lang))
    s = Spectrum(model.landmarks.letters)
    sets = [set(s.grams(r.text).tolist()) for r in rows]
    k = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in sets[:12]] for a in sets])
    values, vectors = np.linalg.eigh(k[:12])
    phi = k @ (vectors / np.sqrt(values))
    y = np.array([[1.0 if r.lang == n else -1.0 for n in model.languages] for r in rows])
    w = np.linalg.solve(phi.T @ phi + 1e-2 * len(rows) / 12 * np.eye(12), phi.T @ y)
    texts = [r.text for r in d.limit(200).collect() if r.text]
    near = [set(s.grams(t).tolist()) for t in texts]
    kernel = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in sets[:12]] for a in near])
    want = kernel @ (vectors / np.sqrt(values)) @ w
    best, score = model.scorer()(texts)
    assert np.allclose(score, np.clip((want.max(axis=1) + 1) / 2, 0, 1), atol=2e-3)
    assert np.mean(best == want.argmax(axis=1)) > 0.99


ENGLISH = "the house and the river were old but the people of this town walked there every day".split()
GERMAN = "das Haus und der Fluss waren alt aber die Leute aus dieser Stadt gingen dort jeden Tag".split()


@pytest.mark.parametrize("one_id", [7, 11, 13, 23])
@pytest.mark.parametrize("other", ["de", "en"])
def test_one_id_for_a_whole_language(docs, one_id, other):
    rng = random.Random(one_id)
    text = lambda words: " ".join(rng.sample(words, 9))
    rows = [(i if other != "en" else one_id, text(ENGLISH), "en") for i in range(800)]
    rows += [(one_id if other != "en" else 5000 + i, text(GERMAN), "de") for i in range(800)]
    rng.shuffle(rows)
    d = docs([r[:2] for r in rows], langs=[r[2] for r in rows])
    sample = training_sample(d.select("doc_id", "text", "lang"), 3, 1, 50)
    learned = {"en", "de"} if crc(one_id, 3) != 1 else {"en" if other == "de" else "de"}
    assert {(r.lang, r.n) for r in sample.groupBy("lang").agg(F.count("*").alias("n")).collect()} == {(x, 50) for x in learned}
    model = fit_languages(d.select("doc_id", "text", "lang"))
    assert set(model.languages) == learned
    if len(learned) == 2:
        best, _ = model.scorer()([text(ENGLISH), text(GERMAN)])
        assert [model.languages[i] for i in best] == ["en", "de"]


def test_copies_of_one_row_keep_the_bound_and_the_others(docs):
    rows = [(7, "the very same words", "en")] * 900 + [(i, f"other words {i}", "en") for i in range(100, 160)]
    d = docs([r[:2] for r in rows], langs=[r[2] for r in rows]).select("doc_id", "text", "lang")
    first = sorted(map(tuple, training_sample(d.repartition(7), 3, 2, 30).collect()))
    assert len(first) == 30 and first == sorted(map(tuple, training_sample(d.repartition(2), 3, 2, 30).collect()))


def test_every_language_is_learned(docs):
    rng = random.Random(1)
    words = {f"l{k:03d}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(12)] for k in range(300)}
    rows = [(i, " ".join(rng.sample(words[k], 9)), k) for i, (k, _) in enumerate((k, n) for k in words for n in range(6))]
    d = docs([r[:2] for r in rows], langs=[r[2] for r in rows])
    model = fit_languages(d.select("doc_id", "text", "lang"))
    learned = {k for i, _, k in rows if crc(i, 3) != 1}
    assert set(model.languages) == learned and sum(len(t.norms) for t in model.landmarks.tiles) == len(learned) > 128
    out = identify_languages(d).collect()
    assert np.mean([r.lang_pred == rows[r.doc_id][2] for r in out if r.held_out and rows[r.doc_id][2] in learned]) > 0.95


def test_language_edges(docs, clashing):
    texts = ["the house and the river", "das Haus und der Fluss", None, "", "123 !!", "und " * 100_000]
    d = clashing(docs([*enumerate(texts), (None, "the end"), (0, "the house")], langs=["en", "de", "en", "de", None, "de", "en", "en"]))
    rows = identify_languages(d).collect()
    assert len(rows) == 8
    assert {r.lang_pred for r in rows if r.doc_id in (2, 3, 4)} == {"und"}
    assert [r.held_out for r in rows if r.doc_id is None] == [True]
    nothing = docs([(1, "some words")], langs=[None])
    assert [(r.lang_pred, r.score) for r in identify_languages(nothing).collect()] == [("und", 0.0)]
    assert identify_languages(docs([])).collect() == []


def many_scripts(n=40):
    """Texts of seven languages; each of the last three has 60 letters of its own, rarer than the others'."""
    rng = random.Random(7)
    abc = {
        "la": "abcdefghijklmnopqrstuvwxyz",
        "ru": "".join(map(chr, range(0x430, 0x450))),
        "el": "".join(map(chr, range(0x3B1, 0x3CA))),
        "hy": "".join(map(chr, range(0x561, 0x587))),
        "zh": "".join(map(chr, range(0x4E00, 0x4E3C))),
        "ja": "".join(map(chr, range(0x3041, 0x307D))),
        "ko": "".join(map(chr, range(0xAC00, 0xAC3C))),
    }
    word = lambda k: "".join(rng.choices(abc[k], k=4))
    some = [(k, " ".join(word(k) for _ in range(8 if i > 3 else 40))) for i, k in enumerate(abc) for _ in range(n)]
    return [(i, t) for i, (_, t) in enumerate(some)], [k for k, _ in some]


def test_letters_beyond_the_alphabet_tell_languages_apart(docs):
    pairs, langs = many_scripts()
    rows = identify_languages(docs(pairs, langs=langs)).collect()
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in rows if r.held_out]) > 0.97
    model = fit_languages(docs(pairs, langs=langs).select("doc_id", "text", "lang"), landmarks=300)
    assert len(model.landmarks.letters) == 95 and not set("\u3041\uac00") <= set(model.landmarks.letters)


def test_wide_ngrams_are_exact():
    s = Spectrum("abc")

    def brute(text):
        t = [c if c.isalpha() or c == "\u093f" else " " for c in text.lower()]
        return {"".join(t[i : i + n]) for n in (1, 2, 3) for i in range(len(t) - n + 1)}

    texts = ["", "\u4e2d", "a\u4e2d", "\u4e2d\u6587ab-c \u6587\u4e2dd", "xyz abc", "\u0939\u093f\u0928 ab", "\U0002000b\U0002000b1", "z" * 5]
    sets = [s.grams(t) for t in texts]
    for t, g in zip(texts, sets, strict=True):
        assert len(g) == len(set(g.tolist())) == len(brute(t)) and (np.diff(g) > 0).all()
    shared = Shared(sets)
    for t, g in zip(texts, sets, strict=True):
        assert shared.count(g).tolist() == [len(brute(t) & brute(u)) for u in texts]
