import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tablelens.llm import induced, suffix_dedup
from tablelens.llm.induced import Files, TupleQueue, sort_in_memory, sorted_suffixes
from tablelens.llm.queries import LLM_QUERIES
from tablelens.llm.suffix_dedup import Anchors, Limits, remove_repeats, shard_repeats


def neighbours(x, cap):
    """Suffixes in descending order and their common prefixes, by comparing them whole."""
    order = sorted(range(len(x)), key=lambda i: x[i:].tolist(), reverse=True)
    common = [0]
    for a, b in zip(order, order[1:], strict=False):
        k = 0
        while k < cap and max(a, b) + k < len(x) and x[a + k] == x[b + k]:
            k += 1
        common.append(k)
    return order, common


def strings(seed, count):
    rng = np.random.default_rng(seed)
    for i in range(count):
        symbols = int(rng.integers(1, 5))
        x = rng.integers(1, symbols + 1, int(rng.integers(1, 120)))
        if i % 3 == 0:
            x = np.tile(x[: int(rng.integers(1, 9))], 8)
        yield np.append(x, 0), symbols + 1


@pytest.mark.parametrize("block", [1, 3, 8, 1 << 16])
@pytest.mark.parametrize("memory", [1, 7, 1000])
def test_order_and_prefixes_equal_comparison(tmp_path, monkeypatch, block, memory):
    monkeypatch.setattr(induced, "BLOCK", block)
    for n, (x, symbols) in enumerate(strings(block * 1000 + memory, 40)):
        for cap in (3, 400):
            folder = tmp_path / f"{n}-{cap}"
            folder.mkdir()
            parts = list(sorted_suffixes(x, symbols, cap, memory, Files(str(folder), n % 2 * 64)))
            assert not [f for f in folder.rglob("*") if f.is_file()]  # nothing outlives the sort
            got = np.concatenate([p for p, _ in parts]).tolist()
            order, common = neighbours(x, cap)
            assert np.concatenate([c for _, c in parts]).tolist() == common
            # what is equal in cap symbols may stand in any order
            assert [x[i : i + cap].tolist() for i in got] == [x[i : i + cap].tolist() for i in order]
            assert sorted(got) == list(range(len(x)))


def test_order_in_memory():
    for x, _ in strings(5, 200):
        order, common = sort_in_memory(x, 400)
        want, prefixes = neighbours(x, 400)
        assert order[::-1].tolist() == want
        assert np.append(common[1:], 0)[::-1].tolist() == prefixes


@pytest.mark.parametrize("descending", [False, True])
def test_queue_leaves_in_order_through_its_files(tmp_path, descending):
    rng = random.Random(3)
    queue, pushed, got = TupleQueue(Files(str(tmp_path)), 5, descending), [], []
    for n in range(60):
        symbols = sorted(rng.choices(range(6), k=rng.randint(1, 4)))
        queue.push(np.array(symbols), np.arange(len(symbols)) + 10 * n, np.zeros(len(symbols), np.uint16))
        pushed += [(s, 10 * n + i) for i, s in enumerate(symbols)]
    assert len(queue._runs) > 20  # of files
    while (symbol := queue.first()) is not None:
        got += [(symbol, int(p)) for positions, _ in queue.pop() for p in positions]
    assert got == sorted(pushed, key=lambda t: (-t[0] if descending else t[0], t[1]))


def test_anchors_depend_on_the_string_alone():
    rng = np.random.default_rng(7)
    for data in (rng.integers(0, 256, 4000).astype(np.uint8), np.zeros(700, np.uint8), np.tile(rng.integers(0, 9, 7), 90).astype(np.uint8)):
        anchors = Anchors(50, 8)
        places, _ = anchors.pick(data)
        for i in rng.integers(0, len(places), 60):
            alone, _ = anchors.pick(data[i : i + 50].copy())
            assert alone.tolist() == [places[i] - i]


def test_shard_repeats(tmp_path):
    contexts = [(b"abcdefgh", 5), (b"xbcdefy", 4), (b"zzzzzz", 3), (b"q" * 4, 1)]
    assert list(shard_repeats(iter(contexts), 4, 10, Files(str(tmp_path)))) == [[(1, 3)], [(1, 3)], [(0, 3)], []]


def brute_force(pairs, width):
    raws = [(t or "").encode() for _, t in pairs]
    counts = Counter(r[i : i + width] for r in raws for i in range(len(r) - width + 1))
    rows = []
    for (doc_id, _), raw in zip(pairs, raws, strict=True):
        gone = {k for i in range(len(raw) - width + 1) if counts[raw[i : i + width]] > 1 for k in range(i, i + width)}
        begins = [k for k in sorted(gone) if k - 1 not in gone]
        ends = [k + 1 for k in sorted(gone) if k + 1 not in gone]
        kept = bytes(c for k, c in enumerate(raw) if k not in gone)
        rows.append((doc_id, len(raw), list(zip(begins, ends, strict=True)), kept))
    return sorted(rows, key=str)


def corpus(seed):
    rng = random.Random(seed)

    def noise(n):
        return "".join(rng.choices("abcdefghijé ", k=n))

    passages = [noise(rng.randint(10, 90)) for _ in range(12)]
    pairs = [(i, "".join(rng.choice([noise(rng.randint(0, 40)), rng.choice(passages)]) for _ in range(rng.randint(0, 8)))) for i in range(150)]
    common = noise(40)  # shorter and longer than a string, in very many texts
    pairs += [(1000 + i, noise(rng.randint(0, 30)) + common[: rng.randint(20, 40)] + noise(rng.randint(0, 30))) for i in range(80)]
    pairs += [(2000 + i, passages[0] * 2) for i in range(30)]
    pairs += [(3000, None), (3001, ""), (3002, "a" * 200), (3003, "ab" * 90), (None, passages[1]), (None, None), (7, passages[2]), (7, passages[2])]
    return pairs


def rows(frame):
    return sorted([(r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in frame.collect()], key=str)


@pytest.mark.parametrize(
    "how",
    [{}, {"anchor": 32}, {"limits": Limits(group=2, shard_bytes=500, memory=3, spare=0)}, {"limits": Limits(group=1), "anchor": 3}],
    ids=str,
)
@pytest.mark.parametrize("broadcast_rows", [1_000_000, 0])
def test_spans_equal_brute_force(docs, clashing, monkeypatch, how, broadcast_rows):
    monkeypatch.setattr(suffix_dedup, "BROADCAST_ROWS", broadcast_rows)
    pairs = corpus(len(str(how)))
    got = remove_repeats(clashing(docs(pairs)).repartition(4), width=32, **({"anchor": 8} | how))
    assert got.columns == ["doc_id", "n_bytes", "spans", "kept"]
    want = brute_force(pairs, 32)
    assert rows(got) == want
    assert sum(len(s) for _, _, s, _ in want) > 100


def test_hot_passages_are_cut_deeper(docs):
    rng = random.Random(11)
    passage = "".join(rng.choices("abcdefgh ", k=396))  # 396 bytes: repeated strings only where neighbours agree, too
    pairs = [(i, "".join(rng.choices("abcdefgh ", k=500)) + "xyz"[: i % 3] + passage + "xyzxyz"[: i % 5] + "".join(rng.choices("abcdefgh ", k=500))) for i in range(120)]
    assert rows(remove_repeats(docs(pairs), limits=Limits(group=3))) == brute_force(pairs, 400)


def test_empty_table_and_texts_across_blocks(docs, monkeypatch):
    assert remove_repeats(docs([])).collect() == []
    monkeypatch.setattr("tablelens.llm.suffix_dedup._BLOCK", 512)
    rng = random.Random(12)
    long = "".join(rng.choices("abcdefgh ", k=5000))
    pairs = [(1, long), (2, "z" * 77 + long[1000:3500]), (3, long[:390] + "!" + long[390:])]
    assert rows(remove_repeats(docs(pairs))) == brute_force(pairs, 400)


def test_passages_of_over_fifty_words_go_from_400_bytes_on(spark, docs, tmp_path):
    rng = random.Random(13)

    def words(count, size):
        cuts = sorted(rng.sample(range(1, (size - count + 1) // 2), count - 1))
        lengths = [2 * (b - a) for a, b in zip([0, *cuts], cuts, strict=False)]
        lengths.append(size - (count - 1) - sum(lengths))
        return " ".join("".join(rng.choices("abcdefgh", k=n)) for n in lengths)

    sizes = [340, 399, 400, 401, 640]
    pairs, gone = [], {}
    for n, size in enumerate(sizes):
        passage = words(60, size)
        assert len(passage) == size and len(passage.split()) == 60
        for i in range(2):  # what stands beside the passage differs
            before, after = words(80, 500) + f".{i}", f"{i}." + words(80, 500)
            pairs.append((10 * n + i, before + passage + after))
            gone[10 * n + i] = size if size >= 400 else 0, before + after if size >= 400 else before + passage + after
    pairs += [(100 + i, words(120, 800)) for i in range(5)]
    gone |= {i: (0, text) for i, text in pairs if i >= 100}
    docs(pairs).write.parquet(f"{tmp_path}/documents.parquet")
    run, _ = LLM_QUERIES["op12_suffix_dedup"]
    got = sorted(tuple(r) for r in run(spark, str(tmp_path)).collect())
    # n_bytes is the whole text's, whatever went from it
    assert got == [(i, len(t), gone[i][0], int(gone[i][0] > 0), hashlib.sha256(gone[i][1].encode()).hexdigest()) for i, t in pairs]
