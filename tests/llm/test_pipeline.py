import random

import corpus_pipeline
from tablelens.sources.tables import read_parquet
from tests.llm.test_decontaminate import brute as brute_leaks
from tests.llm.test_linededup import brute as brute_lines
from tests.llm.test_packing import check as check_packing
from tests.llm.test_packing import reference  # noqa: F401
from tests.llm.test_simhash import brute_components

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def pairs_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_every_stage_against_brute_force(spark, reference):  # noqa: F811
    """Each stage's rows from its own input, as the driver applies them."""
    items = [(r.item_id, r.text) for r in read_parquet(spark, SF, "benchmark").collect()]
    docs = read_parquet(spark, SF, "documents")
    seen = []
    for name, function in corpus_pipeline.STAGES:
        before, out = pairs_of(docs), function(spark, docs, SF)
        seen.append(name)
        if name == "packing":
            check_packing(out.collect(), before, reference)  # every id of every text, once
            break
        assert out.columns == COLUMNS
        after = dict(pairs_of(out))
        if name == "quality":
            labels = {r.doc_id: r.quality for r in read_parquet(spark, SF, "labels").collect()}
            assert all(i in after for i, _ in before if labels.get(i) == 1)
            assert sum(labels.get(i) == 0 for i in after) <= 1 and set(after.items()) <= set(before)
        if name == "line_dedup":
            want = {i: t for i, (n, t) in brute_lines(before).items() if not n or t}
            assert after == want and all(r.n_chars == len(r.text) for r in out.collect())
        if name == "near_dedup":
            assert sorted(after) == sorted(i for i, _, c in brute_components(before, 2) if i == c)
        if name == "decontamination":
            leaked = {i for i, _ in brute_leaks(before, items)}
            assert leaked and sorted(after) == sorted(i for i, _ in before if i not in leaked)
        docs = corpus_pipeline.stage(out, "test")
    assert seen == ["quality", "line_dedup", "near_dedup", "decontamination", "packing"]


def test_run_equals_the_stages_one_by_one(spark):
    docs = read_parquet(spark, SF, "documents")
    for name, function in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(function(spark, docs, SF), name)
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens)
    assert sorted(map(key, docs.collect())) == sorted(map(key, corpus_pipeline.run(spark, SF).collect()))


def test_odd_rows_and_empty_tables(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices("one two three four five".split(), k=30)), "en", "s", 5) for i in range(20)]
    rows += [(None, None, None, None, None), (50, "", None, None, 0), (1, "an id again", "en", "s", 1), (51, None, "en", "s", 0)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, host string, fp string, _c0 string, doc_key string"
    for some in ([(*r, "x", "y", "z", "w") for r in rows], []):
        docs = spark.createDataFrame(some, schema)
        for name, function in corpus_pipeline.STAGES:
            out = corpus_pipeline.stage(function(spark, docs, SF), name)
            if name != "packing":
                assert out.columns == docs.columns
            docs = out
        assert (docs.count() > 0) == bool(some)


def test_very_long_texts(spark, reference):  # noqa: F811
    """Whole texts count in every stage, however long: a copy, one bit's worth of change, and a leak near the end."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(4000)]
    lines = [" ".join(rng.choices(words, k=12)) + "." for _ in range(4_000)]
    item = read_parquet(spark, SF, "benchmark").first()
    long, leaking = "\n".join(lines), "\n".join([*reversed(lines[:2500]), item.text, *lines[2500:2600]])
    rows = [(1, long), (2, long), (3, long + "\none more line of its own."), (4, leaking), (5, "a short text of its own words.")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    stages = dict(corpus_pipeline.STAGES)
    out = {name: stages[name](spark, docs, SF) for name in stages}
    assert set(pairs_of(out["quality"])) <= set(rows)
    want = {i: t for i, (n, t) in brute_lines(rows).items() if not n or t}
    assert dict(pairs_of(out["line_dedup"])) == want and sorted(want) == [1, 3, 4, 5] and want[3] == "one more line of its own."
    assert {r.doc_id for r in out["near_dedup"].collect()} == {i for i, _, c in brute_components(rows, 2) if i == c} == {1, 4, 5}
    assert {r.doc_id for r in out["decontamination"].collect()} == {1, 2, 3, 5}
    check_packing(out["packing"].collect(), rows, reference)
