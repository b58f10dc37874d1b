import random

import duckdb

from tablelens.llm.linededup import dedup_lines
from tablelens.llm.queries import line_dedup_sql


def brute(pairs, size=3):
    """Text of each document, from a dictionary of first occurrences."""
    first, covered = {}, {}
    for i, t in sorted(pairs, key=lambda p: p[0]):
        filled = [(n, x.strip(" ")) for n, x in enumerate((t or "").split("\n")) if x.strip(" ")]
        covered[i] = set()
        for k in range(len(filled) - size + 1):
            window = tuple(x for _, x in filled[k : k + size])
            if first.setdefault(window, (i, k)) != (i, k):
                covered[i].update(range(filled[k][0], filled[k + size - 1][0] + 1))
    out = {}
    for i, t in pairs:
        lines = (t or "").split("\n")
        out[i] = (len(covered[i]), "\n".join(x for n, x in enumerate(lines) if n not in covered[i]) if covered[i] else t)
    return out


def random_pairs(n=80, seed=4):
    rng = random.Random(seed)
    common = [f"common line {i}" for i in range(6)]
    passage = ["first of a passage", "second, ", " third", "fourth", "fifth"]
    pairs = []
    for i in range(n):
        lines = [rng.choice([*common, f"own {i} {k}", "", "  "]) for k in range(rng.randint(0, 14))]
        if rng.random() < 0.4:
            at = rng.randrange(len(lines) + 1)
            lines[at:at] = passage[rng.randrange(3) :]
        pairs.append((i, "\n".join(lines)))
    return [*pairs, (n, None), (n + 1, ""), (n + 2, "\n\n"), (n + 3, "x\n" * 3000), (n + 4, pairs[3][1])]


def test_matches_brute_force_and_sql(docs, clashing):
    pairs = random_pairs()
    d = clashing(docs(pairs))
    out = dedup_lines(d, removed_col="removed", length_col="n_chars")
    assert out.columns == [*d.columns, "removed"]
    rows = out.collect()
    assert {r[0]: (r["removed"], r[1]) for r in rows} == brute(pairs)
    assert all(r[4] == (None if r[1] is None else len(r[1])) for r in rows)
    con = duckdb.connect()
    con.execute("CREATE TABLE d (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO d VALUES (?, ?)", pairs)
    assert {i: (n, t) for i, n, t in con.execute(line_dedup_sql("d")).fetchall()} == brute(pairs)


def test_whole_copies_become_empty_and_can_be_dropped(docs):
    text = "a\nb\nc\nd"
    d = docs([(1, text), (2, text), (3, "a\nb"), (3, "a\nb"), (None, "q\nr\ns"), (4, "q\nr\ns\nt")])
    key = lambda r: str(r[0])
    assert [(r[0], r[1]) for r in sorted(dedup_lines(d).collect(), key=key)] == [
        (1, text), (2, ""), (3, "a\nb"), (3, "a\nb"), (4, "t"), (None, "q\nr\ns")
    ]
    assert 2 not in [r[0] for r in dedup_lines(d, drop_emptied=True).collect()]


def test_repeated_rows_change_alike_and_empty_table(docs):
    d = docs([(1, "a\nb\nc"), (2, "a\nb\nc\nx"), (2, "a\nb\nc\nx")])
    assert sorted(r[1] for r in dedup_lines(d).collect()) == ["a\nb\nc", "x", "x"]
    assert dedup_lines(docs([])).collect() == []


def test_line_ends_and_tabs_are_no_difference(docs):
    d = docs([(1, "a\nb\n\nc\nown"), (2, "x\r\n\ta\r\nb\t\r\n\r\nc\r\ny\r\n"), (3, "\r\n\t\n\v\n\f\n"), (4, "\r\n\t\n\v\n\f\n")])
    got = {r[0]: (r["removed"], r[1]) for r in dedup_lines(d, removed_col="removed").collect()}
    assert got == {1: (0, "a\nb\n\nc\nown"), 2: (4, "x\r\ny\r\n"), **{k: (0, "\r\n\t\n\v\n\f\n") for k in (3, 4)}}


def test_very_long_texts(docs):
    """A text of 320,000 lines: a copy of it, one of its inside, and a passage that it repeats itself."""
    rng = random.Random(6)
    lines = [f"line {i} {rng.random()}" for i in range(320_000)]
    lines[200_000:200_000] = lines[1000:1500]
    inside = "\n".join(["its own begin", *lines[50_000:90_000], "its own end"])
    pairs = [(1, "\n".join(lines)), (2, inside), (3, "\n".join(lines)), (4, "x " * 1_000_000)]
    got = {r[0]: (r["removed"], r[1]) for r in dedup_lines(docs(pairs), removed_col="removed").collect()}
    assert got == brute(pairs)
    assert [got[i][0] for i in (1, 2, 3, 4)] == [500, 40_000, 320_500, 0] and got[2][1] == "its own begin\nits own end"
