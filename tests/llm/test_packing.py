import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tablelens.llm.packing import differencing, pack_block, pack_documents, word_tokenizer
from tablelens.llm.queries import public_tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_tokenizers(reference):
    t, rng = word_tokenizer(PATH), random.Random(1)
    parts = ["a", "É", "é", "́", ".", ",", "...", ". ", " ", "\n", "\t", " ", "Σ", "ς", "İ", "ß", "1", "'s", "it's"]
    parts += ["<|endoftext|>", "<|ENDOFTEXT|>", "<|", "中文", "ſ", "ﬁ", "Word.", "y.,", "≠", "̸", "\x00", "\x1c", "\x85", "😀", "ª"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 9))) for _ in range(8000)]
    for text in [*texts, "x" * 500, "long words " * 5000]:
        assert t(text).tolist() == reference(text), repr(text)


def test_differencing_balances():
    assert sorted(np.bincount(differencing([8, 7, 6, 5, 4], 2), weights=[8, 7, 6, 5, 4])) in ([14, 16], [15, 15])
    rng = random.Random(3)
    sizes = [rng.randint(1, 500) for _ in range(600)]
    loads = np.bincount(differencing(sizes, 40), weights=sizes)
    assert loads.sum() == sum(sizes) and loads.max() - loads.min() <= 2
    assert differencing([], 3).tolist() == []


def test_window_count_rises_until_capacity_holds():
    sizes = [1100] * 7  # two never share a window, though four windows would hold the sum
    window = pack_block(sizes, 2048)
    assert np.bincount(window, weights=sizes).max() <= 2048 and len(set(window.tolist())) == 7


def check(rows, pairs, reference, capacity=2048):
    """Every id in one piece, sequences gapless and within capacity; the share of padding."""
    ids = [(i, [*reference(t), 1]) for i, t in pairs]
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == {i for i, _ in ids}
    for i, own in ids:
        if sum(j == i for j, _ in ids) > 1:
            continue
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(own))
            part = own[at : at + r.length]
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            at += r.length
        assert at == len(own)
    total = 0
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
        total += at
    assert total == sum(len(own) for _, own in ids)
    return 1 - total / (len(sequences) * capacity)


def test_pieces_of_all_documents(docs, reference, clashing):
    rng = random.Random(5)
    words = "stone river green light house, walks over. Under a very old small tree".split()
    pairs = [(i, " ".join(rng.choices(words, k=int(rng.paretovariate(0.8) * 20) % 9000))) for i in range(400)]
    pairs += [(900, None), (901, ""), (902, " \n"), (None, "no id"), (7, "an id again"), (903, "a " * 2047), (904, "a " * 5000)]
    rows = pack_documents(clashing(docs(pairs)).repartition(3), public_tokenizer()).collect()
    assert check(rows, pairs, reference) < 0.05  # three partitions' last, small blocks
    assert pack_documents(docs([]), public_tokenizer()).collect() == []


def test_pieces_stay_whole_if_asked(docs, reference):
    pairs = [(i, "a " * n) for i, n in enumerate([1500, 700, 300, 1200, 5000, 1])]
    rows = pack_documents(docs(pairs), public_tokenizer(), piece=2048).collect()
    check(rows, pairs, reference)
    assert sorted(r.length for r in rows if r.doc_id == 4) == [5001 - 4096, 2048, 2048]
    assert len(rows) == 8
