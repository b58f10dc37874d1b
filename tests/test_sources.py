"""Delimited-text fixtures of FIXTURES.md §2."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from tablelens.operators import clean, groups, profile
from tablelens.operators.roles import classify_columns
from tablelens.plans.reports import ads_report, posts_report, tweets_report
from tablelens.sources import commit_report, first_line_counts, load_tables, read_report, read_table, sniff_delimiter, write_report


@pytest.fixture
def write(tmp_path):
    def w(name, text):
        p = tmp_path / name
        p.write_text(text, encoding="utf-8")
        return str(p)

    return w


def test_plain_csv_and_tsv(spark, write):
    csv = write("plain.csv", "id,name,v\n1,a,10\n2,b,20\n3,c,30\n4,d,40\n5,e,50\n")
    tsv = write("plain.tsv", "id\tname\tv\n1\ta\t10\n2\tb\t20\n3\tc\t30\n4\td\t40\n5\te\t50\n")
    assert sniff_delimiter(spark, csv) == "," and sniff_delimiter(spark, tsv) == "\t"
    for p in (csv, tsv):
        d = read_table(spark, p)
        assert d.columns == ["id", "name", "v"] and d.count() == 5
        assert dict(d.dtypes) == {"id": "string", "name": "string", "v": "string"}


def test_commas_in_tsv_header(spark, write):
    p = write("commas_in_tsv.tsv", "a,b\tc,d\te\tf\n1,2\t3,4\t5\t6\n")
    assert sniff_delimiter(spark, p) == "\t"
    assert read_table(spark, p).columns == ["a,b", "c,d", "e", "f"]


def test_padded_header(spark, write):
    p = write("padded_header.csv", " id , name ,v\n1,a,2\n")
    assert read_table(spark, p).columns == ["id", "name", "v"]


def test_ragged_rows_pad_and_cut(spark, write):
    p = write("ragged.csv", "a,b,c\n1,2\n3,4,5,6\n7,8,9\n")
    got = [tuple(r) for r in read_table(spark, p).collect()]
    assert got == [("1", "2", None), ("3", "4", "5"), ("7", "8", "9")]


def test_quoted_cells(spark, write):
    p = write("quoted.csv", 'id,text\n1,"line one\nline two"\n2,"a, b"\n3,"say ""hi"""\n4,""\n')
    got = {r.id: r.text for r in read_table(spark, p, multi_line=True).collect()}
    assert got["1"] == "line one\nline two" and got["2"] == "a, b" and got["3"] == 'say "hi"'
    assert got["4"] in (None, "")
    assert clean.normalise_nulls(read_table(spark, p, multi_line=True)).where("text IS NULL").count() == 1


def test_null_token_file(spark, write):
    tokens = ["", "null", "NULL", "None", "N/A", "NA", "na", "n/a", "none", "nan", "#n/a", "#null!", "undefined"]
    lines = ["k,v"] + [f"{i},{t}" for i, t in enumerate(tokens)] + [f"{len(tokens)}, NA ", f"{len(tokens) + 1},keep"]
    p = write("nulls.csv", "\n".join(lines) + "\n")
    d = read_table(spark, p)
    strict = clean.normalise_nulls(d, "strict").where("v IS NULL").count()
    folded = clean.normalise_nulls(d, "folded").where("v IS NULL").count()
    assert strict == 7  # '', null, NULL, None, N/A, NA, ' NA '
    assert folded == len(tokens) + 1  # every token in any case, plus ' NA '


def test_numbers_file(spark, write):
    cells = ["12", " 12 ", "1e5", ".5", "3.", "+2", "1_000", "1d", "nan", "inf", '"1,000"', "abc", ""]
    p = write("numbers.csv", "k,v\n" + "\n".join(f"{i},{c}" for i, c in enumerate(cells)) + "\n")
    d = clean.coerce_numeric(read_table(spark, p), ["v"])
    got = [r.v for r in d.orderBy(d.k.cast("int")).collect()]
    assert got[:6] == [12.0, 12.0, 1e5, 0.5, 3.0, 2.0]
    assert got[6:9] == [None, None, None] and got[9] == float("inf") and got[10:] == [None, None, None]


def test_typing_file(spark, write):
    lines = ["full,r81,r80,r79,none,empty"]
    for i in range(100):
        lines.append(",".join([str(i), "x" if i < 19 else str(i), "x" if i < 20 else str(i), "x" if i < 21 else str(i), f"t{i}", ""]))
    d = read_table(spark, write("typing.csv", "\n".join(lines) + "\n"))
    assert classify_columns(d).numeric == ("full", "r81")
    assert classify_columns(d, threshold=0.8, inclusive=True).numeric == ("full", "r81", "r80")
    assert classify_columns(d, threshold=1.0, inclusive=True).numeric == ("full",)


def test_bool_and_dates(spark, write):
    p = write("bool_dates.csv", "flag,day,bad\ntrue,2024-01-01,2024-01-01\nfalse,2024-02-29,2024-02-30\n")
    d = read_table(spark, p)
    assert "flag" in classify_columns(d).text  # booleans are text (V8)
    out = clean.coerce_dates(d)
    assert dict(out.dtypes)["day"] == "timestamp_ntz" and dict(out.dtypes)["bad"] == "string"


def test_json_file(spark, write):
    # A blank line is no record (as in csv.reader); the empty cell is quoted.
    p = write("json.csv", 'j\n"{""a"":1}"\n"[1,2]"\n{}\n[]\n""\nplain\n{bad\n[\'a\']\n')
    d = clean.normalise_json(read_table(spark, p), ["j"])
    assert [r.j for r in d.collect()] == ['{"a":1}', "[1,2]", None, None, None, "plain", "{bad", "['a']"]


def test_dupes_file(spark, write):
    p = write("dupes.csv", "a,b\nx,1\nx,1\nx,NULL\nx,\n\"a|b\",c\na,\"b|c\"\n")
    d = clean.normalise_nulls(read_table(spark, p), "strict")
    c = clean.dedup_counts(d).first()
    assert (c.rows_before, c.rows_after) == (6, 4)


def test_keys_file(spark, write):
    big = 2**53
    lines = ["id,k", f"{big},a", f"{big + 1},a", ",b", ",b", "7,c"]
    d = read_table(spark, write("keys.csv", "\n".join(lines) + "\n"))
    sizes = {r.id: r.size for r in groups.group_sizes(d, ["id"]).collect()}
    # Ids stay text: the two ids above 2^53 do not merge (V25); NULL is a group.
    assert sizes[str(big)] == 1 and sizes[str(big + 1)] == 1 and sizes[None] == 2


def test_empty_file(spark, write):
    d = read_table(spark, write("empty.csv", "a,b\n"))
    assert d.columns == ["a", "b"] and d.count() == 0
    ov = profile.dataset_overview(d).first()
    assert ov.row_count == 0 and ov.missing_pct is None
    assert profile.numeric_profile(d, ["a"]).first()["count"] == 0


def test_write_report(spark, tmp_path):
    d = spark.range(5)
    out = write_report({"r": d}, str(tmp_path / "rep"))
    assert spark.read.parquet(out["r"]).count() == 5


def test_read_table_with_null_policy(spark, write):
    p = write("policy.csv", "a,b\nNULL,1\n n/a ,2\nx,3\n")
    assert read_table(spark, p, nulls="strict").where("a IS NULL").count() == 1
    assert read_table(spark, p, nulls="folded").where("a IS NULL").count() == 2
    assert read_table(spark, p, nulls=["x"]).where("a IS NULL").count() == 1


def test_odd_column_names_end_to_end(spark, write):
    p = write("odd.csv", "Page Category,a.b,x`y,Likes\nnews,1,2,3\nnews,4,5,6\nsport,7,8,9\n")
    d = read_table(spark, p, nulls="empty")
    assert d.columns == ["Page Category", "a.b", "x`y", "Likes"]
    prof = {r.column_name: r for r in profile.numeric_profile(d, ["a.b", "x`y"]).collect()}
    assert prof["a.b"]["count"] == 3 and prof["x`y"].max == 8.0
    sizes = {r["Page Category"]: r.size for r in groups.group_sizes(d, ["Page Category"]).collect()}
    assert sizes == {"news": 2, "sport": 1}


def test_directory_of_files(spark, tmp_path):
    folder = tmp_path / "parts"
    folder.mkdir()
    for i in range(3):
        (folder / f"part-{i}.csv").write_text(f"id,v\n{i},{i * 10}\n{i + 10},{i}\n", encoding="utf-8")
    d = read_table(spark, str(folder))
    assert d.columns == ["id", "v"] and d.count() == 6


def test_row_seq_keeps_file_order(spark, write):
    lines = ["page,v"] + [f"p{(i * 7) % 5},{i}" for i in range(40)]
    d = read_table(spark, write("seq.csv", "\n".join(lines) + "\n"), row_seq="_row_seq")
    assert [int(r.v) for r in d.orderBy("_row_seq").collect()] == list(range(40))
    first = [r.page for r in groups.first_groups(d, ["page"], "_row_seq", k=5).orderBy("rank").collect()]
    assert first == ["p0", "p2", "p4", "p1", "p3"]  # order of first appearance in the file


def test_row_seq_over_files_of_unequal_size(spark, tmp_path):
    """Path order, whatever order Spark reads the files in; the column is no data."""
    folder, at = tmp_path / "unequal", 0
    folder.mkdir()
    for name, n in (("a", 2), ("b", 500), ("c", 40)):
        lines = [f"p{k % 7},{k}" for k in range(at, at + n)]
        (folder / f"{name}.csv").write_text("page,v\n" + "\n".join(lines) + "\n", encoding="utf-8")
        at += n
    d = read_table(spark, str(folder), row_seq="row_seq")
    assert [int(r.v) for r in d.orderBy("row_seq").collect()] == list(range(542))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        assert [int(r.v) for r in d.orderBy("row_seq").collect()] == list(range(542))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    rep = posts_report(d, page_key="page", post_key="v", category_key="page", metrics=["v"], order_by="row_seq")
    assert rep["overview"].first().column_count == 2
    assert [r.page for r in rep["first_pages"].orderBy("rank").collect()] == [f"p{k}" for k in range(7)]
    doubled = d.unionByName(d.withColumn("row_seq", F.struct(F.lit("z").alias("path"), F.lit(1).cast("bigint").alias("split"), F.lit(1).cast("bigint").alias("line"))))
    for report in (tweets_report, ads_report):
        assert report(doubled, key_sets=[["page"]], order_by="row_seq")["overview"].first().duplicates_removed == 542


def test_line_breaks_in_cells(spark, write):
    p = write("multi.csv", 'a,b\n"x\ny",1\nz,2\n')
    for how in ({}, {"line_breaks": True}, {"multi_line": True}):
        assert {(r.a, r.b) for r in read_table(spark, p, **how).collect()} == {("x\ny", "1"), ("z", "2")}
    assert read_table(spark, p, line_breaks=False).count() == 3


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "60")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def _cells(rng):
    parts = ["a", "b", '"', ",", "\n", "x y", " ", "\r\n", '""', "é", "\n\n\n" * 9]
    return "".join(rng.choices(parts, k=rng.randint(0, 6)))


@pytest.mark.parametrize("sep", [",", "\t"])
def test_records_of_many_splits_equal_the_csv_module(spark, tmp_path, small_splits, sep):
    rng, want = random.Random(len(sep) + ord(sep)), {}
    for name, n in (("a", 60), ("b", 4), ("c", 33)):
        rows = [[f"{name}{i}", *[_cells(rng) for _ in range(3)]] for i in range(n)]
        with open(tmp_path / f"{name}.csv", "w", encoding="utf-8", newline="") as f:
            csv.writer(f, delimiter=sep, lineterminator="\n").writerows([["k", " x ", "y", "z"], *rows])
        want.update({r[0]: r[1:] for r in rows})
    d = read_table(spark, str(tmp_path), sep=sep, row_seq="place")
    assert d.columns == ["k", "x", "y", "z", "place"]
    rows = d.orderBy("place").collect()
    assert [r.k for r in rows] == list(want)
    assert {r.k: [r.x or "", r.y or "", r.z or ""] for r in rows} == want
    assert len({(r.place.path, r.place.split) for r in rows}) > 20  # tasks of three files


def test_records_with_bare_and_open_quotes(spark, tmp_path, small_splits):
    """Quotes inside a cell that does not begin with one are characters; an open cell ends with its file."""
    (tmp_path / "a.csv").write_text('k,v\n1,5" pipe\n2,say "hi"\n3,"x"y"\n' + "4,plain\n" * 20 + '5,"open\nuntil the end', encoding="utf-8")
    (tmp_path / "b.csv").write_text('k,v\r\n6,"one\r\ntwo"\r\n\r\n7,last\r\n', encoding="utf-8", newline="")
    got = {r.k: r.v for r in read_table(spark, str(tmp_path), line_breaks=True).collect()}
    assert got.keys() == set("1234567")
    assert (got["1"], got["2"], got["4"], got["6"], got["7"]) == ('5" pipe', 'say "hi"', "plain", "one\r\ntwo", "last")
    assert "until the end" in got["5"]


def test_records_ragged_and_without_rows(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_text('a,b,c\n"1\n",2\n3,4,5,6\n', encoding="utf-8")
    assert sorted(map(tuple, read_table(spark, str(tmp_path)).collect()), key=str) == [("1\n", "2", None), ("3", "4", "5")]
    (tmp_path / "a.csv").write_text("a,b\n", encoding="utf-8")
    assert read_table(spark, str(tmp_path), line_breaks=True).collect() == []


def test_files_without_line_breaks_are_read_without_a_shuffle(spark, write, capsys):
    d = read_table(spark, write("plain.csv", 'id,text\n1,"a, b"\n2,"say ""hi"""\n'))
    d.explain()
    assert "Exchange" not in capsys.readouterr().out


def test_other_encodings_keep_line_breaks(spark, tmp_path):
    p = tmp_path / "latin.csv"
    p.write_bytes('a,b\n"é\nü",1\n'.encode("latin-1"))
    assert [tuple(r) for r in read_table(spark, str(p), encoding="ISO-8859-1").collect()] == [("é\nü", "1")]


def test_first_line_counts_is_no_query_of_a_table():
    import __spark_entry__ as entry

    assert "first_line_counts" not in entry.queries() and "first_line_counts" not in entry.oracle_sql()


def test_first_line_counts(spark, write):
    assert tuple(first_line_counts(spark, write("tabs.tsv", "a\tb,c\td\n")).first()) == (2, 1)


def test_load_tables(spark):
    tables = load_tables(spark, "/root/testdata/sf0.001", ["region", "nation"])
    assert {n: d.count() for n, d in tables.items()} == {"region": 5, "nation": 25}


def test_a_failed_write_leaves_the_last_whole_report(spark, tmp_path):
    path = str(tmp_path / "report")
    with pytest.raises(ValueError, match="no whole report"):
        read_report(spark, path)
    with pytest.raises(ValueError, match="needs a frame"):
        commit_report({}, path)
    broken = spark.range(3).select(F.raise_error(F.lit("stop")).alias("id"))
    half = {"a": spark.range(9), "b": spark.range(9), "c": broken}
    with pytest.raises(Exception, match="stop"):
        commit_report(half, path)
    with pytest.raises(ValueError, match="no whole report"):
        read_report(spark, path)
    first = commit_report({"a": spark.range(1), "b": spark.range(2), "c": spark.range(3)}, path)
    with pytest.raises(Exception, match="stop"):
        commit_report(half, path)
    counts = lambda v=None: {k: f.count() for k, f in read_report(spark, path, v).items()}
    assert counts() == {"a": 1, "b": 2, "c": 3}
    last = commit_report({"a": spark.range(5), "d": spark.range(6)}, path, fmt="json")
    assert counts() == counts(last) == {"a": 5, "d": 6}
    assert counts(first) == {"a": 1, "b": 2, "c": 3}
    with pytest.raises(ValueError, match="no whole version"):
        read_report(spark, path, "v-none")
