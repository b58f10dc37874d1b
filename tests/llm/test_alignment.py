import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tablelens.llm import alignment
from tablelens.llm.alignment import aligned_tokens, chunk_lists, divide, link_support, overlaps, token_pair
from tablelens.llm.queries import public_token_pair

PARTS = ["a", "the", "É", "é", "́", ".", ",", "...", " ", "  ", "\n", "\n\n ", "'s", "12", "中文", "😀", "word", "ing", "-", "(", "ß"]
ODD = ["\t", "\r", "\r\n", "\xa0", "　", "\x00", "\x1c", "\x85", "▁", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "ﬁ"]


@pytest.fixture(scope="module")
def reference():
    """n_a, n_b, groups and links of one text, from whole encodings and sets of ends."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [x for x in range(256) if x not in printable]
    byte_of = {chr(x): x for x in printable} | {chr(256 + i): x for i, x in enumerate(rest)}

    def ranges(parts):
        out, at = [], 0
        for p in parts:
            out.append((at, at + len(p)))
            at += len(p)
        return out

    def align(text):
        raw = (" " + text).encode() if text else b""
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids_a]
        pieces = [b.id_to_piece(i) for i in ids_b]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, pieces, strict=True)]
        if not text or b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            return 0, 0, [], []
        ra, rb = ranges(bytes_a), ranges(bytes_b)
        cuts = sorted({e for _, e in ra} & {e for _, e in rb})
        groups = []
        for s, e in zip([0, *cuts], cuts, strict=False):
            groups.append(([i for i, r in zip(ids_a, ra, strict=True) if s <= r[0] < e], [i for i, r in zip(ids_b, rb, strict=True) if s <= r[0] < e]))
        links = [(i, j) for i, x in zip(ids_a, ra, strict=True) for j, y in zip(ids_b, rb, strict=True) if x[0] < y[1] and y[0] < x[1]]
        return len(ids_a), len(ids_b), groups, links

    return align


def grouped(groups):
    return ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)


def texts(seed, n, odd=0.2):
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS + ODD if rng.random() < odd else PARTS, k=rng.randint(0, 14))) for _ in range(n)]


def test_leaves_are_the_intervals_between_shared_ends():
    rng = random.Random(2)
    for _ in range(2000):
        n = rng.randint(1, 40)
        a = sorted({*rng.sample(range(1, n + 1), rng.randint(0, n)), n})
        b = sorted({*rng.sample(range(1, n + 1), rng.randint(0, n)), n})
        common = sorted({*a} & {*b})
        known = sorted({*rng.sample(common, rng.randint(0, len(common))), n})
        cuts = [np.searchsorted(x, known) + 1 for x in (a, b)]
        leaves = divide(np.array(a), np.array(b), *cuts).tolist()
        assert [a[x[1] - 1] for x in leaves] == common
        assert [x[0] for x in leaves] == [0, *[x[1] for x in leaves[:-1]]]
        assert [x[2] for x in leaves] == [0, *[x[3] for x in leaves[:-1]]]
        spans = [list(zip([0, *e], e, strict=False)) for e in (a, b)]
        want = [(i, j) for i, x in enumerate(spans[0]) for j, y in enumerate(spans[1]) if x[0] < y[1] and y[0] < x[1]]
        i, j, _ = overlaps(np.array(a), np.array(b))
        assert list(zip(i.tolist(), j.tolist(), strict=True)) == want
    none = np.array([], np.int64)
    assert divide(none, none, none, none).tolist() == []


def test_each_end_is_looked_up_once(monkeypatch):
    looked, plain = Counter(), np.searchsorted
    a, b = np.array([*range(2, 4000, 2), 4001]), np.array([*range(1, 40), 3990, 4001])

    def search(ends, some, *rest):
        if ends is b:
            looked.update(np.atleast_1d(some).tolist())
        return plain(ends, some, *rest)

    monkeypatch.setattr(alignment.np, "searchsorted", search)
    assert len(divide(a, b, np.array([len(a)]), np.array([len(b)]))) == 21
    assert max(looked.values()) == 1


def test_chunks_encode_like_whole_texts(reference):
    pair = token_pair(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    some = texts(1, 3000)
    zeros = 0
    for text, (entries, whole) in zip(some, pair.align(some), strict=True):
        n_a, n_b, groups, links = reference(text)
        assert (sum(e[0] for e in entries), sum(e[1] for e in entries)) == (n_a, n_b), repr(text)
        assert b";".join(e[3] for e in entries).decode() == grouped(groups), repr(text)
        assert whole == bool(n_a)
        zeros += bool(text) and not whole
    assert zeros > 10  # texts that a tokenizer changes


def test_words_of_many_scripts_encode_like_the_tokenizer(reference):
    pair = token_pair(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(6)
    scripts = [(0x21, 0x7F), (0xA1, 0x250), (0x370, 0x374), (0x386, 0x3CF), (0x400, 0x482), (0x48A, 0x514), (0x3041, 0x3095), (0x30A1, 0x30FB), (0x4E00, 0x9FA6), (0xAC00, 0xD7A4)]
    some = [" ".join("".join(chr(rng.randrange(*rng.choice(scripts))) for _ in range(rng.randint(1, 8))) for _ in range(12)) for _ in range(1500)]
    for text, (entries, _) in zip(some, pair.align(some), strict=True):
        n_a, n_b, groups, links = reference(text)
        assert b";".join(e[3] for e in entries).decode() == grouped(groups), repr(text)
        assert np.frombuffer(b"".join(e[4] for e in entries), "<i8").tolist() == [a << 32 | b for a, b in links]


def test_pieces_of_a_long_text_keep_its_chunks(monkeypatch):
    text = "one  two\n \nthree four " * 50
    whole = [c for piece in chunk_lists(text) for c in piece]
    monkeypatch.setattr(alignment, "_PIECE", 10)
    assert [c for piece in chunk_lists(text) for c in piece] == whole
    assert "".join(whole) == " " + text


def want_rows(pairs, reference):
    found = [(i, *reference(t)) for i, t in pairs]
    counts = Counter(x for *_, links in found for x in links)
    top = {}
    for (_, b), c in counts.items():
        top[b] = max(top.get(b, 0), c)
    return [
        (
            i, n_a, n_b, len(groups), len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links),
            hashlib.sha256(grouped(groups).encode()).hexdigest() if groups else "",
        )
        for i, n_a, n_b, groups, links in found
    ]


@pytest.mark.parametrize("pair_limit", [1 << 20, 0])
def test_support_equals_brute_force(docs, clashing, reference, pair_limit, monkeypatch):
    some = texts(7, 260)
    pairs = [*enumerate(some), (900, None), (901, ""), (902, " "), (None, "no id here"), (None, None), (7, "an id again"), (7, "an id again"), (903, "x" * 900)]
    pairs += [(1000 + i, "the same words again and again.") for i in range(40)]
    got = link_support(clashing(docs(pairs)).repartition(4), public_token_pair(), pair_limit=pair_limit)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want_rows(pairs, reference), key=str)


def test_no_rows_and_no_tokens(docs):
    assert link_support(docs([]), public_token_pair()).collect() == []
    assert [tuple(r) for r in link_support(docs([(1, None)]), public_token_pair()).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_a_full_memory_changes_nothing(reference, monkeypatch):
    monkeypatch.setattr(alignment, "CACHE", 5)
    pair = alignment.TokenPair(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    some = texts(9, 200, odd=0)
    for at in range(0, 200, 20):
        for text, (entries, _) in zip(some[at : at + 20], pair.align(some[at : at + 20]), strict=True):
            assert b";".join(e[3] for e in entries).decode() == grouped(reference(text)[2])


def test_real_outputs(docs, reference):
    row = aligned_tokens(docs([(1, "Alignment of unusual tokenisations, naturally.")]), public_token_pair()).first()
    n_a, n_b, groups, links = reference("Alignment of unusual tokenisations, naturally.")
    assert (row.n_a, row.n_b, row.groups) == (n_a, n_b, grouped(groups))
    assert [(x >> 32, x & 0xFFFFFFFF) for x in row.links] == links
