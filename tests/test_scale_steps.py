"""Steps that the text analyses share: done once for each cell, in ranges that follow the rows."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from tablelens.functions.nulls import WHITESPACE, strip_ws
from tablelens.functions.numeric import parses_as_number, to_double
from tablelens.operators import clean, engagement, groups, profile
from tablelens.plans import catalogue_text
from tablelens.sources import records, write_delimited


def plan(d):
    return d._jdf.queryExecution().optimizedPlan().toString()


def aggregates(d):
    return [line for line in plan(d).splitlines() if "Aggregate " in line]


def ends_inside(line, sep):
    """The state of the line's end, character by character."""
    state, begins = "out", True
    for ch in line:
        if ch == '"':
            state = "closed" if state == "in" else "in" if state == "closed" or begins else "out"
        elif state == "closed":
            state = "out"
        begins = ch == sep and state != "in"
    return state == "in"


@pytest.mark.parametrize("sep", [",", "\t", ";", "|", "^", "]", "-"])
def test_lines_of_whole_cells_end_outside(spark, sep):
    rng = random.Random(5)
    pieces = ['"', '""', sep, "a", " ", '{"a', "\r", f'"{sep}', f'{sep}"']
    lines = ["".join(rng.choices(pieces, k=rng.randint(0, 9))) for _ in range(3000)]
    cell = lambda: rng.choice(["", "x y", '"a, b"', '"say ""O"", ok"', '""', f'"{sep}"'])
    lines += [sep.join(cell() for _ in range(4)).replace(",", sep) + rng.choice(["", "\r"]) for _ in range(300)]
    lines += [sep.join(['"' + 'a""' * 200_000 + '"'] * 2), "a" + sep, '"' + "b" * 500_000]
    d = spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "i int, v string").repartition(4)
    got = d.select("i", records._ends_inside(F.col("v"), sep, False).alias("inside"), F.col("v").rlike(records._whole_cells(sep)).alias("whole"))
    found = {r.i: r for r in got.collect()}
    assert [found[i].inside for i in range(len(lines))] == [ends_inside(v, sep) for v in lines]
    assert all(found[i].whole for i in range(3000, 3301)) and not found[3302].whole


def test_whole_cells_are_told_without_the_walk(spark, tmp_path, monkeypatch):
    def written(name, *lines):
        (tmp_path / name).write_text("".join(f"{line}\n" for line in lines))
        return str(tmp_path / name)

    whole = written("whole.csv", "k,v", 'a,"x, ""y"""', '"b",', ",c\r", '"d","e"\r')
    odd = written("odd.csv", "k,v", '5" nail,"x"', '"a"b,c')  # not whole, but no line ends inside
    torn = written("torn.csv", "k,v", 'a,"x', 'y"')
    assert [records.has_line_breaks(spark, path) for path in (whole, odd, torn)] == [False, False, True]
    monkeypatch.setattr(records, "_ends_inside", lambda *_: pytest.fail("lines of whole cells are walked"))
    assert not records.has_line_breaks(spark, whole)


def test_cells_are_trimmed_once(spark):
    d = spark.createDataFrame([(" None ",), (None,), ("\u3000x\u00a0",), ("é ",)], "v string")
    text = plan(clean.normalise_nulls(d, "folded"))
    assert text.count("octet_length") == 1, text
    assert [r.v for r in clean.normalise_nulls(d, "folded").collect()] == [None, None, "x", "é"]


def test_stripping_and_numbers_equal_python(spark):
    rng = random.Random(6)
    marks = [*WHITESPACE, *"+-.059eEiInNfFtTyYd", "é", "\u0661", "inf", "1e5", "12.5", "\x1b", "\u200b"]
    cells = ["".join(rng.choices(marks, k=rng.randint(0, 5))) for _ in range(5000)] + [f"{w}-1.5{w}" for w in WHITESPACE]
    d = spark.createDataFrame([(i, c) for i, c in enumerate([*cells, None])], "i int, v string")
    rows = d.select("i", strip_ws("v").alias("s"), parses_as_number("v").alias("p"), to_double("v").alias("x")).orderBy("i").collect()
    number = re.compile(r"[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf(inity)?)", re.IGNORECASE | re.ASCII)
    for c, r in zip(cells, rows, strict=False):
        text = c.strip(WHITESPACE)
        fits = number.fullmatch(text) is not None
        assert (r.s, r.p, r.x) == (text, fits, float(text) if fits else None), repr(c)
    assert tuple(rows[-1])[1:] == (None, None, None)


def test_aggregates_get_converted_cells(spark):
    d = spark.createDataFrame([("a", "1.25"), ("a", " 2 "), (None, "x"), ("b", "inf")], "k string, v string")
    frames = {
        "groups": groups.group_table(d, ["k"], ["v"], exact_scale=2),
        "stats": groups.grouped_numeric_stats(d, ["k"], ["v"], exact_scale=2),
        "totals": engagement.group_metric_totals(d, "k", ["v"], exact_scale=2),
        "profile": profile.numeric_profile(d, ["v"], exact_scale=2),
    }
    for name, frame in frames.items():
        own = aggregates(frame)
        assert own and not any("RLIKE" in line or "isnan" in line for line in own), name
    found = {r.k: (r["size"], r._n0, r._a0, r._lo0, r._hi0) for r in frames["groups"].collect()}
    assert found == {"a": (2, 2, 1.625, 1.25, 2.0), None: (1, 0, None, None, None), "b": (1, 1, float("inf"), float("inf"), float("inf"))}


def test_ranges_follow_the_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalogue_text, "RANGE_ROWS", 40)
    rows = [(i // 3, i % 50, i % 9, i % 7 + 1, float(i % 11), "ANR"[i % 3], "OF"[i % 2]) for i in range(2000)]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string"
    spark.createDataFrame([*rows, *[(None, *rows[0][1:])] * 3], names).write.parquet(str(tmp_path / "lineitem.parquet"))
    written = []
    monkeypatch.setattr(catalogue_text, "write_delimited", lambda d, path: written.append(path) or write_delimited(d, path))
    got = {r.status: r.row_count for r in catalogue_text.prefix_first_groups(spark, str(tmp_path)).collect()}
    files = [f for f in os.listdir(written[-1].removeprefix("file:")) if f.endswith(".csv")]
    assert 40 <= len(files) <= 51 and sum(got.values()) == 500
