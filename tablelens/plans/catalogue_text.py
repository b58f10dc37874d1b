"""Registered queries over delimited text, and the remaining operators' rows.

The three analyses start here as they do in real use: from CSV files with
padded headers, null tokens, JSON cells, quoted cells, bad cells and real
full-row duplicates, staged from ``lineitem`` in the shared folder. The SQL
applies the same rules to the same table.
"""

from __future__ import annotations

import os
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.functions.display import round_stat
from tablelens.operators import clean, engagement, groups, heavy, jsonpaths, profile, roles, types
from tablelens.operators.ordering import global_rank
from tablelens.operators.state import DISTINCT_ERROR, RANK_ERROR, ProfileState, rank_of
from tablelens.plans import catalogue as base
from tablelens.plans.catalogue import SCALE, _t, query, rank_sql, rnd, sinj
from tablelens.plans.reports import ads_report, posts_report, tweets_report
from tablelens.session import shared_dir
from tablelens.sources import (
    commit_report,
    first_file_rows,
    first_records,
    prefix_role_table,
    read_report,
    read_table,
    write_delimited,
    write_report,
)

# ------------------------------------------------------------ the text table

TEXT_COLS = ["ad_id", "page_id", "spend", "reach", "region", "note", "status"]
_TEXT_ROWS_SQL = """SELECT CAST(l_orderkey AS VARCHAR) AS ad_id,
  CASE l_suppkey % 7 WHEN 0 THEN 'NULL' WHEN 1 THEN 'N/A' ELSE CAST(l_suppkey AS VARCHAR) END AS page_id,
  CASE WHEN l_linenumber % 5 = 0 THEN 'None' ELSE CAST(l_quantity AS VARCHAR) END AS spend,
  CAST(l_partkey AS VARCHAR) AS reach,
  CASE l_partkey % 3 WHEN 0 THEN '{}' WHEN 1 THEN '{"a, b": 1}' ELSE '[]' END AS region,
  'say "' || l_linestatus || '", ok' AS note, l_returnflag AS status FROM lineitem"""
# Every tenth order's rows come twice: full-row duplicates.
TEXT_SQL = f"({_TEXT_ROWS_SQL} UNION ALL {_TEXT_ROWS_SQL} WHERE l_orderkey % 10 = 0)"


def _text_file(spark: SparkSession, sf: str, row_seq: str | None = None) -> DataFrame:
    """The text table, written as CSV with padded header names and read back."""
    part = F.col("l_partkey") % 3
    page = F.col("l_suppkey") % 7
    li = _t(spark, sf, "lineitem")
    rows = li.unionByName(li.where(F.col("l_orderkey") % 10 == 0)).select(
        F.col("l_orderkey").cast("string").alias(" ad_id "),
        F.when(page == 0, "NULL").when(page == 1, "N/A").otherwise(F.col("l_suppkey").cast("string")).alias("page_id "),
        F.when(F.col("l_linenumber") % 5 == 0, "None").otherwise(F.col("l_quantity").cast("string")).alias(" spend"),
        F.col("l_partkey").cast("string").alias("reach"),
        F.when(part == 0, "{}").when(part == 1, '{"a, b": 1}').otherwise("[]").alias("region"),
        F.concat(F.lit('say "'), "l_linestatus", F.lit('", ok')).alias("note"),
        F.col("l_returnflag").alias("status"),
    )
    target = shared_dir(spark, "text-table")
    write_delimited(rows, target)
    return read_table(spark, target, row_seq=row_seq)


def _cleaned_sql(null_tokens: str, json: bool, distinct: bool, fold: bool) -> str:
    """The table after null tokens, JSON cells and dedup."""

    def cell(c: str) -> str:
        v = f"lower({c})" if fold else c
        more = f" OR {c} IN ('{{}}', '[]')" if json and c == "region" else ""
        return f"CASE WHEN {v} IN {null_tokens}{more} THEN NULL ELSE {c} END AS {c}"

    return f"(SELECT {'DISTINCT ' * distinct}{', '.join(map(cell, TEXT_COLS))} FROM {TEXT_SQL} x)"


def _typed_sql(table: str, numeric: list[str]) -> str:
    cells = [f"TRY_CAST({c} AS DOUBLE) AS {c}" if c in numeric else c for c in TEXT_COLS]
    return f"(SELECT {', '.join(cells)} FROM {table} y)"


STRICT_SQL = "('', 'null', 'NULL', 'None', 'N/A', 'NA')"
ADS_SQL = _typed_sql(_cleaned_sql(STRICT_SQL, True, True, False), ["spend", "reach"])
TWEETS_SQL = _typed_sql(_cleaned_sql(base.FOLDED_SQL, False, True, True), ["page_id", "spend", "reach"])
POSTS_SQL = _typed_sql(_cleaned_sql("('')", False, False, False), ["spend", "reach"])
ADS_TEXT = ["ad_id", "page_id", "region", "note", "status"]


def _overview(table: str, numeric: int, text: int, dedup: bool = True) -> str:
    sql = base._overview_sql("cells", TEXT_COLS, numeric, text)
    gone = f", CAST((SELECT count(*) FROM {TEXT_SQL} z) - count(*) AS BIGINT) AS duplicates_removed FROM cells" if dedup else " FROM cells"
    return f"WITH cells AS {table} " + sql.replace(" FROM cells", gone)


def _over(table: str, sql: str) -> str:
    """``sql`` over a view named ``t``; a query that starts with its own views keeps them."""
    return f"WITH cells AS {table}" + (", " + sql[len("WITH ") :] if sql.startswith("WITH ") else " " + sql)


# -------------------------------------------------- cells with line breaks

_DOC_CELLS = ["doc_id", "text", "lang", "source", "n_chars"]


@query(
    "csv_line_breaks",
    "SELECT CAST(doc_id AS VARCHAR) AS doc_id, coalesce(text, '') AS text, lang, source, CAST(n_chars AS VARCHAR) AS n_chars FROM documents",
)
def csv_line_breaks(spark, sf):
    """Whole texts, with their line feeds, through CSV files that are read by split."""
    target = shared_dir(spark, "documents-text")
    write_delimited(_t(spark, sf, "documents").select(*_DOC_CELLS), target)
    return read_table(spark, target, sep=",").withColumn("text", F.coalesce("text", F.lit("")))


# ------------------------------------------------------- dedup by digest

# Whole texts; every fifth document's row comes again, with its id and without.
_WIDE_SQL = """(SELECT doc_id, text, lang FROM documents UNION ALL SELECT doc_id, text, lang FROM documents WHERE doc_id % 5 = 0
  UNION ALL SELECT NULL, text, lang FROM documents WHERE doc_id % 5 = 0)"""


def _wide_rows(spark: SparkSession, sf: str) -> DataFrame:
    docs = _t(spark, sf, "documents").select("doc_id", "text", "lang")
    some = docs.where(F.col("doc_id") % 5 == 0)
    return docs.unionAll(some).unionAll(some.withColumn("doc_id", F.lit(None).cast("bigint")))


@query("dedup_wide_rows", f"SELECT DISTINCT doc_id, text, lang FROM {_WIDE_SQL} w")
def dedup_wide_rows(spark, sf):
    """Whole texts compared only where their 128-bit digests repeat."""
    return clean.dedup_by_digest(_wide_rows(spark, sf))


@query(
    "dedup_wide_counts",
    f"""SELECT CAST(count(*) AS BIGINT) AS rows_before, (SELECT count(*) FROM (SELECT DISTINCT * FROM {_WIDE_SQL} x) y) AS rows_after,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {_WIDE_SQL} x) y) AS duplicates_removed FROM {_WIDE_SQL} w""",
)
def dedup_wide_counts(spark, sf):
    return clean.dedup_counts_by_digest(_wide_rows(spark, sf))


# ----------------------------------------------- deviations and whole numbers


def _exact_std_sql(c: str, ddof: int) -> str:
    """The deviation of a column with two decimals from whole-number sums, unrounded."""
    s = f"(SELECT CAST(count({c}) AS HUGEINT) AS n, sum(CAST(round({c} * 100) AS HUGEINT)) AS t, sum(CAST(round({c} * 100) AS HUGEINT) * CAST(round({c} * 100) AS HUGEINT)) AS s2 FROM lineitem) a"
    q = f"(SELECT *, CAST(floor(CAST(t AS DOUBLE) / CAST(n AS DOUBLE)) AS HUGEINT) AS q FROM {s}) b"
    r = f"(SELECT *, CAST(t AS HUGEINT) - q * n AS r FROM {q}) c"
    spread = "CAST(CAST(s2 AS HUGEINT) - q * (CAST(t AS HUGEINT) + r) AS DOUBLE) - CAST(r AS DOUBLE) * CAST(r AS DOUBLE) / CAST(n AS DOUBLE)"
    return f"SELECT '{c}' AS column_name, CAST(n AS BIGINT) AS count, sqrt(({spread}) / (CAST(n AS DOUBLE) - {ddof})) / 100.0 AS std FROM {r}"


_TWO_DECIMALS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("exact_deviations", " UNION ALL ".join(_exact_std_sql(c, 1) for c in _TWO_DECIMALS))
def exact_deviations(spark, sf):
    """A10: deviations to the last bit, whatever order the rows come in."""
    shuffled = _t(spark, sf, "lineitem").select(*_TWO_DECIMALS).repartition(7)
    return profile.numeric_profile(shuffled, _TWO_DECIMALS, exact_scale=SCALE).select("column_name", "count", "std")


@query("exact_population_deviations", " UNION ALL ".join(_exact_std_sql(c, 0) for c in _TWO_DECIMALS))
def exact_population_deviations(spark, sf):
    """A11, V12, as above."""
    d = _t(spark, sf, "lineitem").select(*_TWO_DECIMALS)
    return profile.numeric_profile(d, _TWO_DECIMALS, ddof=0, exact_scale=SCALE).select("column_name", "count", "std")


# Ids beyond 2^53, where neighbours are one double.
_BIG = 2**53 + 1
_BIG_IDS = {"big_id": f"l_orderkey + {_BIG}", "negative": f"-l_partkey - {_BIG}", "some": f"CASE WHEN l_linenumber > 3 THEN l_suppkey * {2**40} END"}


@query(
    "whole_number_profile",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, {i} AS position, count({e}) AS count, count(*) - count({e}) AS missing,
  CAST(sum(CAST({e} AS HUGEINT)) AS DOUBLE) / CAST(count({e}) AS DOUBLE) AS mean, CAST(min({e}) AS BIGINT) AS min, CAST(max({e}) AS BIGINT) AS max,
  CAST(sum(CAST({e} AS HUGEINT)) AS VARCHAR) AS total FROM lineitem"""
        for i, (c, e) in enumerate(_BIG_IDS.items())
    ),
)
def whole_number_profile(spark, sf):
    """64-bit whole numbers keep all their bits."""
    d = _t(spark, sf, "lineitem").select(*[F.expr(e).cast("bigint").alias(c) for c, e in _BIG_IDS.items()])
    return profile.whole_number_profile(d).withColumn("total", F.col("total").cast("string"))


# --------------------------------------------------- state of growing folders

_STATE_COLS = ["l_quantity", "l_extendedprice", "l_discount"]
_STATE_TEXT = ["l_suppkey", "l_returnflag", "l_shipdate"]


def _grown_state(spark: SparkSession, sf: str) -> ProfileState:
    """Two runs: half of ``lineitem``, and then, beside it, the rest."""
    root = shared_dir(spark, "profile-state")
    source, odd = os.path.join(root, "rows"), F.col("l_orderkey") % 2
    li = _t(spark, sf, "lineitem").select(*_STATE_COLS, *_STATE_TEXT, "l_orderkey")
    state = ProfileState(spark, os.path.join(root, "state"), _STATE_COLS, _STATE_TEXT, [["l_returnflag", "l_suppkey"]], SCALE)
    for k in (0, 1):
        li.where(odd == k).drop("l_orderkey").write.mode("append").parquet(source)
        state.update(source)
    return state


def _state_profile_sql(c: str) -> str:
    mean = f"(SELECT CAST(sum(CAST(round({c} * 100) AS HUGEINT)) AS DOUBLE) / 100.0 / CAST(count({c}) AS DOUBLE) FROM lineitem)"
    return (
        f"SELECT x.column_name, x.count, (SELECT count(*) - count({c}) FROM lineitem) AS missing, {mean} AS mean, x.std, "
        f"(SELECT min({c}) FROM lineitem) AS min, (SELECT max({c}) FROM lineitem) AS max FROM ({_exact_std_sql(c, 1)}) x"
    )


@query("state_profile_two_runs", " UNION ALL ".join(map(_state_profile_sql, _STATE_COLS)))
def state_profile_two_runs(spark, sf):
    """A7-A12 from the state of two runs, unrounded: as one run over all rows."""
    found = _grown_state(spark, sf).profile().where(F.col("position") < len(_STATE_COLS))
    return found.select("column_name", "count", "missing", "mean", "std", "min", "max")


@query("state_group_sizes", "SELECT l_returnflag, l_suppkey, count(*) AS size FROM lineitem GROUP BY ALL")
def state_group_sizes(spark, sf):
    """G1 from the state of two runs."""
    return _grown_state(spark, sf).group_sizes()


@query(
    "sketches_within_error",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS exact_distinct, true AS distinct_within, true AS quantiles_within FROM lineitem"
        for c in [*_STATE_COLS, *_STATE_TEXT]
    ),
)
def sketches_within_error(spark, sf):
    """Merged sketches against the exact numbers; every column's error is within its bound."""
    li = _t(spark, sf, "lineitem")
    found = _grown_state(spark, sf).profile()
    frames = []
    for c in [*_STATE_COLS, *_STATE_TEXT]:
        own = found.where(F.col("column_name") == c)
        exact = F.count_distinct(c)
        within = [F.abs(own.select("distinct_count").scalar() - exact) <= F.greatest(exact * F.lit(DISTINCT_ERROR), F.lit(0.5))]
        ranks = F.lit(True)
        for p in (25, 50, 75) if c in _STATE_COLS else ():
            low, high = rank_of(F.col(c), own.select(f"q{p}").scalar())
            ranks = ranks & (low - RANK_ERROR <= p / 100) & (high + RANK_ERROR >= p / 100)
        frames.append(li.agg(exact.alias("exact_distinct"), within[0].alias("distinct_within"), ranks.alias("quantiles_within")).select(F.lit(c).alias("column_name"), "*"))
    return reduce(DataFrame.unionByName, frames)


# ------------------------------------------------------- types in one scan

_DAY_SQL = "strftime(o_orderdate, '%Y-%m-%d')"
_TYPED_CELLS = {
    "id": "CAST(o_orderkey AS VARCHAR)",
    "price": "CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_totalprice AS VARCHAR) END",
    "day": "{day}",
    "moment": "CASE WHEN o_orderkey % 2 = 0 THEN {day} || ' 12:30:00' ELSE {day} END",
    "flag": "CASE WHEN o_orderkey % 3 = 0 THEN 'true' ELSE 'False' END",
    "cell": """CASE WHEN o_orderkey % 2 = 0 THEN '{{"a": 1}}' ELSE '[1, 2]' END""",
    "mixed": "CASE o_orderkey % 4 WHEN 0 THEN '2024-02-30' WHEN 1 THEN {day} WHEN 2 THEN 'true' ELSE '7' END",
    "nothing": "CAST(NULL AS VARCHAR)",
}


def _type_table_sql() -> str:
    cells = ", ".join(f"{e.format(day=_DAY_SQL)} AS {c}" for c, e in _TYPED_CELLS.items())
    day = "regexp_matches(v, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') AND TRY_CAST(v AS DATE) IS NOT NULL"
    moment = f"(({day}) OR regexp_matches(v, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[ T][0-9:]{{8}}$') AND TRY_CAST(v AS TIMESTAMP) IS NOT NULL)"
    tests = {
        "boolean": "lower(v) IN ('true', 'false')", "whole": "regexp_matches(v, '^[+-]?[0-9]{1,18}$')", "number": f"regexp_matches(v, {base.GUARD_SQL})",
        "date": day, "time": moment, "json": "v[1] IN ('{', '[') AND json_valid(v)",
    }
    counts = ", ".join(f"count(*) FILTER (WHERE {t}) AS n_{k}" for k, t in tests.items())
    parts = [f"SELECT '{c}' AS column_name, {i} AS position, count(v) AS non_null, {counts} FROM (SELECT {c} AS v FROM t) x{i}" for i, c in enumerate(_TYPED_CELLS)]
    kind = " ".join(f"WHEN n_{k} = non_null THEN '{k}'" for k in tests)
    return f"""WITH t AS (SELECT {cells} FROM orders), c AS ({' UNION ALL '.join(parts)}),
k AS (SELECT *, CASE WHEN non_null = 0 THEN 'empty' {kind} ELSE 'text' END AS kind FROM c)
SELECT *, CASE WHEN kind IN ('whole', 'number') THEN 'numeric' ELSE 'text' END AS role FROM k"""


def _typed_cells(spark: SparkSession, sf: str) -> DataFrame:
    day = "date_format(o_orderdate, 'yyyy-MM-dd')"
    return _t(spark, sf, "orders").select(*[F.expr(e.format(day=day).replace("VARCHAR", "STRING")).alias(c) for c, e in _TYPED_CELLS.items()])


@query("type_table", _type_table_sql())
def type_table(spark, sf):
    """Kinds of eight text columns from one aggregate."""
    return types.type_table(_typed_cells(spark, sf))


# ------------------------------------------------------ structure of JSON cells

_PROPS = """CASE event_id % 5 WHEN 1 THEN '{"k": "x", "tags": [1, 2.5, "a", null]}' WHEN 2 THEN '{"k": null, "deep": {"er": {"est": true}}}'
  WHEN 3 THEN '{bad' ELSE props END"""


@query(
    "json_paths",
    f"""WITH t AS (SELECT {_PROPS} AS j FROM events), v AS (SELECT j FROM t WHERE json_valid(j)),
n AS (SELECT regexp_replace(e.fullkey, '\\[[0-9]+\\]', '[*]', 'g') AS path, e.type AS type FROM v, json_tree(v.j) e),
k AS (SELECT path, CASE type WHEN 'UBIGINT' THEN 'whole' WHEN 'BIGINT' THEN 'whole' WHEN 'DOUBLE' THEN 'number' WHEN 'VARCHAR' THEN 'text' ELSE lower(type) END AS kind FROM n
  UNION ALL SELECT '$', 'invalid' FROM t WHERE j IS NOT NULL AND NOT json_valid(j))
SELECT 'props' AS column_name, path, kind, count(*) AS count FROM k GROUP BY path, kind""",
)
def json_paths(spark, sf):
    """Kinds and counts by path, with arrays, nulls, deep objects and bad cells injected."""
    return jsonpaths.json_paths(_t(spark, sf, "events").select(F.expr(_PROPS).alias("props")), ["props"])


# --------------------------------------------------------- committed reports


@query(
    "report_committed_versions",
    "SELECT l_returnflag, l_linestatus, count(*) AS size FROM lineitem GROUP BY l_returnflag, l_linestatus",
)
def report_committed_versions(spark, sf):
    """A report whose third frame fails leaves the report before it whole."""
    li, path = _t(spark, sf, "lineitem"), os.path.join(shared_dir(spark, "reports"), "report")
    sizes = groups.group_sizes(li, ["l_returnflag", "l_linestatus"])
    commit_report({"sizes": sizes, "flags": groups.group_sizes(li, ["l_returnflag"])}, path)
    half = {"sizes": sizes.limit(1), "flags": sizes.limit(1), "broken": li.select(F.raise_error(F.lit("no third frame")))}
    try:
        commit_report(half, path)
    except PySparkException as failed:
        if "no third frame" not in str(failed):
            raise
    return read_report(spark, path)["sizes"].select("l_returnflag", "l_linestatus", "size")


# ---------------------------------------------------------- frequent values


def _heavy_sql(table: str, cols: list[str], k: int) -> str:
    parts = [
        f"""SELECT '{c}' AS column_name, {i} AS position, CAST(row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) AS BIGINT) AS rank,
  CAST({c} AS VARCHAR) AS value, count(*) AS count FROM {table} WHERE {c} IS NOT NULL GROUP BY CAST({c} AS VARCHAR) QUALIFY rank <= {k}"""
        for i, c in enumerate(cols)
    ]
    return " UNION ALL ".join(parts)


_HEAVY_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_returnflag"]


@query("heavy_values", _heavy_sql("lineitem", _HEAVY_COLS, 5))
def heavy_values(spark, sf):
    """The five most frequent values of columns with few values, many, and nearly as many as rows."""
    return heavy.heavy_values(_t(spark, sf, "lineitem"), _HEAVY_COLS, 5)


@query("heavy_values_of_texts", _heavy_sql("documents", ["text", "lang", "source", "doc_id"], 3))
def heavy_values_of_texts(spark, sf):
    """Whole texts and unique ids; the hot source."""
    return heavy.heavy_values(_t(spark, sf, "documents"), ["text", "lang", "source", "doc_id"], 3)


# ------------------------------------------------------- prefixes of files

#: Rows of a table for each range that one task sorts and writes.
RANGE_ROWS = 500_000


def _ranges(table: DataFrame, least: int) -> int:
    """Ranges to sort a table in: a number that grows with its rows (a count that reads Parquet footers alone)."""
    return max(least, -(-table.count() // RANGE_ROWS))


def _event_files(spark: SparkSession, sf: str) -> str:
    """The events' text cells in twelve CSV files or more, in the order of their ids."""
    target = shared_dir(spark, "events-text")
    place, ranges = F.col("event_id").cast("long"), _ranges(_t(spark, sf, "events"), 12)
    write_delimited(base._events_text(spark, sf).repartitionByRange(ranges, place).sortWithinPartitions(place), target)
    return target


def _prefix_roles(spark: SparkSession, sf: str, **sample) -> DataFrame:
    path = _event_files(spark, sf)
    return prefix_role_table(
        lambda n: first_records(spark, path, n, ",", "place"),
        lambda: read_table(spark, path, ",", row_seq="place"),
        "place", threshold=1.0, inclusive=True, **sample,
    )


@query("prefix_roles_first_rows", base._prefix_classify_sql(None, 1000))
def prefix_roles_first_rows(spark, sf):
    """Typing on the first 1000 rows, from the first of many files alone."""
    return _prefix_roles(spark, sf, sample_rows=1000)


@query("prefix_roles_first_values", base._prefix_classify_sql(100, None))
def prefix_roles_first_values(spark, sf):
    """Typing on each column's first 100 values; prefixes grow until all columns have them."""
    return _prefix_roles(spark, sf, sample_values=100)


@query("prefix_rows_of_files", "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 100")
def prefix_rows_of_files(spark, sf):
    """The first rows of Parquet files, from the files that hold them."""
    target = shared_dir(spark, "orders-in-order")
    o = _t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    o.repartitionByRange(_ranges(o, 16), "o_orderkey").sortWithinPartitions("o_orderkey").write.parquet(target)
    return first_file_rows(spark, target, 100)


@query(
    "prefix_first_groups",
    f"""WITH p AS (SELECT * FROM {TEXT_SQL} t ORDER BY CAST(ad_id AS BIGINT), reach, spend LIMIT 500),
g AS (SELECT status, min(CAST(ad_id AS BIGINT)) AS seen, count(*) AS row_count FROM p GROUP BY status)
SELECT status, row_count FROM g""",
)
def prefix_first_groups(spark, sf):
    """Groups of the first 500 rows in file order."""
    target = shared_dir(spark, "text-in-order")
    order = [F.col("ad_id").cast("long"), F.col("reach"), F.col("spend")]
    # By all of the order, so that an id with very many rows (or none at all) is no single range.
    rows = _text_file(spark, sf).repartitionByRange(_ranges(_t(spark, sf, "lineitem"), 9), *order).sortWithinPartitions(*order)
    write_delimited(rows, target)
    d = first_records(spark, target, 500, ",", "place")
    return groups.first_groups(d, ["status"], "place").select("status", "row_count")


# ----------------------------------------------------------------------- ads


def _ads(spark: SparkSession, sf: str):
    return ads_report(
        _text_file(spark, sf), key_sets=[["page_id"], ["page_id", "ad_id"], ["page_id", "absent"]],
        json_columns=["region"], id_columns=["ad_id", "page_id"], exact_scale=SCALE,
    )


@query("ads_text_overview", _overview(ADS_SQL, 2, 5))
def ads_text_overview(spark, sf):
    """Text to overview: header trim, strict tokens, JSON cells, full-row dedup, typing."""
    return _ads(spark, sf)["overview"]


@query("ads_text_numeric_profile", _over(ADS_SQL, base._numeric_profile_sql("cells", ["spend", "reach"], "stddev_samp", quartiles=True)))
def ads_text_numeric_profile(spark, sf):
    return rnd(_ads(spark, sf)["numeric_profile"], {"std": 4, "q25": 4, "q50": 4, "q75": 4})


@query("ads_text_text_profile", _over(ADS_SQL, base._categorical_sql("cells", ADS_TEXT)))
def ads_text_text_profile(spark, sf):
    return _ads(spark, sf)["text_profile"]


@query("ads_text_top_groups_two_keys", _over(ADS_SQL, base._top_groups_sql("cells", ["page_id", "ad_id"], 10)))
def ads_text_top_groups_two_keys(spark, sf):
    return _ads(spark, sf)["groups_page_id_ad_id_top"]


@query("ads_text_drilldown", _over(ADS_SQL, base._drilldown_sql("cells", "page_id", ["spend", "reach"], 3)))
def ads_text_drilldown(spark, sf):
    return _ads(spark, sf)["groups_page_id_drilldown"]


@query(
    "ads_text_size_stats",
    _over(
        ADS_SQL,
        """WITH s AS (SELECT page_id, ad_id, count(*) AS size FROM cells GROUP BY ALL)
SELECT count(*) AS group_count, CAST(sum(size) AS BIGINT) AS row_count, round(avg(size), 4) AS mean_size,
  round(stddev_samp(size), 4) AS std_size, min(size) AS min_size, max(size) AS max_size,
  quantile_cont(size, 0.25) AS q25, quantile_cont(size, 0.5) AS q50, quantile_cont(size, 0.75) AS q75 FROM s""",
    ),
)
def ads_text_size_stats(spark, sf):
    return rnd(_ads(spark, sf)["groups_page_id_ad_id_size_stats"], {"mean_size": 4, "std_size": 4})


def _candidates_sql(cols: list[tuple[int, str]]) -> str:
    each = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {i} AS position, count(DISTINCT {c}) AS unique_count FROM cells" for i, c in cols
    )
    return f"""WITH u AS ({each}) SELECT column_name, position, unique_count,
  CAST(row_number() OVER (ORDER BY unique_count, position) AS BIGINT) AS choice FROM u WHERE unique_count BETWEEN 2 AND 20"""


@query("ads_text_candidates", _over(ADS_SQL, _candidates_sql([(2, "region"), (3, "note"), (4, "status")])))
def ads_text_candidates(spark, sf):
    return _ads(spark, sf)["grouping_candidates"]


@query("ads_text_candidate_top", _over(ADS_SQL, base._top_groups_sql("cells", ["note"], 10)))
def ads_text_candidate_top(spark, sf):
    """The chosen key (two different notes) leads to its top groups."""
    return _ads(spark, sf)["candidate_note_top"]


# -------------------------------------------------------------------- tweets


def _tweets(spark: SparkSession, sf: str):
    return tweets_report(
        _text_file(spark, sf), key_sets=[["status"], ["page_id", "status"]], metrics=["spend", "reach"],
        engagement_keys=["status"], id_columns=["ad_id"], exact_scale=SCALE,
    )


@query("tweets_text_overview", _overview(TWEETS_SQL, 3, 4))
def tweets_text_overview(spark, sf):
    return _tweets(spark, sf)["overview"]


@query("tweets_text_text_profile", _over(TWEETS_SQL, base._categorical_sql("cells", ["ad_id", "region", "note", "status"])))
def tweets_text_text_profile(spark, sf):
    return _tweets(spark, sf)["text_profile"]


@query("tweets_text_group_count", _over(TWEETS_SQL, "SELECT count(*) AS group_count FROM (SELECT DISTINCT page_id, status FROM cells) k"))
def tweets_text_group_count(spark, sf):
    return _tweets(spark, sf)["groups_page_id_status_count"]


@query("tweets_text_group_numeric", _over(TWEETS_SQL, base._grouped_stats_sql("cells", "status", ["page_id", "spend", "reach"], 10)))
def tweets_text_group_numeric(spark, sf):
    return _tweets(spark, sf)["groups_status_numeric"]


@query(
    "tweets_text_engagement",
    _over(
        TWEETS_SQL,
        f"""WITH e AS (SELECT status, coalesce(spend, 0) + coalesce(reach, 0) AS te FROM cells),
g AS (SELECT status, count(*) AS posts, {base.xsum('te')} AS total_engagement, {base.xmean('te')} AS avg_engagement
  FROM e GROUP BY status)
SELECT {rank_sql('total_engagement DESC, status ASC NULLS FIRST')} AS rank, status, posts, total_engagement, avg_engagement FROM g""",
    ),
)
def tweets_text_engagement(spark, sf):
    return _tweets(spark, sf)["engagement_status"]


# --------------------------------------------------------------------- posts


def _posts(spark: SparkSession, sf: str):
    return posts_report(
        _text_file(spark, sf, row_seq="row_seq"), page_key="page_id", post_key="ad_id", category_key="status",
        metrics=["spend", "reach"], ranking_metrics=["spend", "reach"], order_by="row_seq", exact_scale=SCALE,
    )


@query("posts_text_overview", _overview(POSTS_SQL, 2, 5, dedup=False))
def posts_text_overview(spark, sf):
    """Bad cells of a numeric column become NULL and count as missing; the order column is no data."""
    return _posts(spark, sf)["overview"]


@query(
    "posts_text_numeric_profile",
    _over(
        POSTS_SQL,
        "SELECT column_name, position, count, missing, round(mean, 2) AS mean, round(std, 2) AS std, min, max FROM ("
        + base._numeric_profile_sql("cells", ["spend", "reach"], "stddev_samp")
        + ") p",
    ),
)
def posts_text_numeric_profile(spark, sf):
    return _posts(spark, sf)["numeric_profile"]


@query("posts_text_text_profile", _over(POSTS_SQL, base._categorical_sql("cells", ADS_TEXT)))
def posts_text_text_profile(spark, sf):
    return _posts(spark, sf)["text_profile"]


@query("posts_text_category_share", _over(POSTS_SQL, base._share_sql("cells", "status")))
def posts_text_category_share(spark, sf):
    return _posts(spark, sf)["category_share"]


@query(
    "posts_text_category_means",
    _over(
        POSTS_SQL,
        f"""SELECT status, count(*) AS row_count, {base.xmean('spend')} AS spend_mean, count(spend) AS spend_count,
  {base.xmean('reach')} AS reach_mean, count(reach) AS reach_count FROM cells GROUP BY status""",
    ),
)
def posts_text_category_means(spark, sf):
    return _posts(spark, sf)["category_means"]


@query("posts_text_category_rankings", _over(POSTS_SQL, base._rankings_sql("cells", "status", ["spend", "reach"], 5)))
def posts_text_category_rankings(spark, sf):
    return _posts(spark, sf)["category_rankings"]


@query("posts_text_page_engagement", _over(POSTS_SQL, base._page_sql("cells", "page_id", ["spend", "reach"], 10)))
def posts_text_page_engagement(spark, sf):
    return _posts(spark, sf)["page_engagement"]


@query("posts_text_page_posts", _over(POSTS_SQL, "SELECT count(*) AS combinations FROM (SELECT DISTINCT page_id, ad_id FROM cells) k"))
def posts_text_page_posts(spark, sf):
    return _posts(spark, sf)["page_post_count"]


# ------------------------------------------------------- files and raw lines


@query(
    "first_groups_from_files",
    f"""WITH g AS (SELECT o_custkey, min(o_orderkey) AS seen, count(*) AS row_count, {base.xmean('o_totalprice')} AS m,
    count(o_totalprice) AS o_totalprice_count FROM orders GROUP BY o_custkey ORDER BY seen LIMIT 10)
SELECT {rank_sql('seen')} AS rank, CAST(o_custkey AS VARCHAR) AS o_custkey, row_count, m AS o_totalprice_mean,
  o_totalprice_count FROM g""",
)
def first_groups_from_files(spark, sf):
    """First groups in file order, over CSV files of very unequal size."""
    o = _t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    cuts = o.agg(F.expr("percentile_approx(o_orderkey, array(0.02, 0.9))")).first()[0] or [0, 0]
    root = shared_dir(spark, "unequal-files")
    for k, rows in enumerate((F.col("o_orderkey") <= cuts[0], F.col("o_orderkey").between(cuts[0] + 1, cuts[1]), F.col("o_orderkey") > cuts[1])):
        part = o.where(rows)
        parts = max(1, part.rdd.getNumPartitions()) if k != 1 else _ranges(o, 3)
        write_delimited(part.repartitionByRange(parts, "o_orderkey").sortWithinPartitions("o_orderkey"), os.path.join(root, f"{k}"))
    d = read_table(spark, os.path.join(root, "*"), row_seq="row_seq")
    out = groups.first_groups(d, ["o_custkey"], "row_seq", k=10, cols=["o_totalprice"], exact_scale=SCALE)
    return out.drop("first_seen")


def _raw_lines(spark: SparkSession, sf: str) -> str:
    """Customers as lines with padded headers, some too short, some too long."""
    c, cell = _t(spark, sf, "customer"), [F.col("c_custkey").cast("string"), F.col("c_name"), F.col("c_mktsegment")]
    line = (
        F.when(F.col("c_custkey") % 5 == 0, F.concat_ws("\t", *cell[:2]))
        .when(F.col("c_custkey") % 7 == 0, F.concat_ws("\t", *cell, F.lit("one,more"), F.lit("cell")))
        .otherwise(F.concat_ws("\t", *cell))
    )
    target = shared_dir(spark, "raw-lines")
    # One column whose header is the whole header line; a separator that no line holds keeps lines as they are.
    c.select(line.alias(" key \tname \t segment")).write.option("header", True).option("sep", "\x01").option("quote", "").option(
        "ignoreLeadingWhiteSpace", False
    ).option("ignoreTrailingWhiteSpace", False).csv(target)
    return target


@query(
    "ragged_rows",
    "SELECT CAST(c_custkey AS VARCHAR) AS key, c_name AS name, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS segment FROM customer",
)
def ragged_rows(spark, sf):
    """Header names stripped, short rows padded with NULL, long rows cut."""
    return read_table(spark, _raw_lines(spark, sf))


@query("report_sink_roundtrip", base._top_groups_sql("orders", ["o_orderstatus", "o_orderpriority"], 10))
def report_sink_roundtrip(spark, sf):
    """A report frame written by the sink and read back."""
    top = groups.top_groups(_t(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"], k=10)
    return spark.read.parquet(write_report({"top": top}, shared_dir(spark, "report"))["top"])


# ------------------------------------------------------------ single operators


@query(
    "coerce_dates_all_or_nothing",
    f"""SELECT o_orderkey, o_orderdate, {base._date_ok_sql('o_orderdate_clean')} AS o_orderdate_clean, o_orderstatus
FROM {base.ORDERDATE_TEXT_SQL}""",
)
def coerce_dates_all_or_nothing(spark, sf):
    """Only the column whose every value parses is converted."""
    return clean.coerce_dates(base._orderdate_text(spark, sf).select("o_orderkey", "o_orderdate", "o_orderdate_clean", "o_orderstatus"))


@query(
    "classify_forced_text",
    base._classify_sql(0.8, False).replace("CASE WHEN non_null > 0", "CASE WHEN column_name NOT IN ('event_id', 'value') AND non_null > 0"),
)
def classify_forced_text(spark, sf):
    """Columns that are declared text stay text whatever they hold."""
    return roles.role_table(base._events_text(spark, sf), force_text=["value"], id_columns=["event_id"])


@query(
    "restrict_to_two_keys",
    f"""WITH d AS (SELECT {sinj('o_custkey', 'o_orderkey', 11)} AS o_custkey, {sinj('o_orderpriority', 'o_orderkey', 5)} AS o_orderpriority,
  o_orderkey FROM orders),
top AS (SELECT o_custkey, o_orderpriority, count(*) AS size FROM d GROUP BY ALL
  ORDER BY size DESC, o_custkey NULLS FIRST, o_orderpriority NULLS FIRST LIMIT 5)
SELECT o_orderkey FROM d WHERE EXISTS (SELECT 1 FROM top WHERE top.o_custkey IS NOT DISTINCT FROM d.o_custkey
  AND top.o_orderpriority IS NOT DISTINCT FROM d.o_orderpriority)""",
)
def restrict_to_two_keys(spark, sf):
    """Rows of the five largest groups of a composite key with NULL parts."""
    d = base._orders_injected(spark, sf)
    top = groups.top_groups(d, ["o_custkey", "o_orderpriority"], k=5)
    return groups.restrict_to_groups(d, top, ["o_custkey", "o_orderpriority"], 5).select("o_orderkey")


@query(
    "rounded_statistics",
    "SELECT column_name, count, missing, round(mean, 1) AS mean, round(std, 1) AS std, round(min, 1) AS min, round(max, 1) AS max FROM ("
    + base._numeric_profile_sql("lineitem", base.PROFILE_COLS, "stddev_samp")
    + ") p",
)
def rounded_statistics(spark, sf):
    """Every statistic rounded half up."""
    p = profile.numeric_profile(_t(spark, sf, "lineitem"), base.PROFILE_COLS, exact_scale=SCALE)
    return p.select("column_name", "count", "missing", *[round_stat(c, 1).alias(c) for c in ("mean", "std", "min", "max")])


@query(
    "global_rank_payload",
    f"""SELECT {rank_sql('o_totalprice DESC, o_orderkey')} AS rank, o_orderkey, o_orderpriority, o_orderdate FROM orders""",
)
def global_rank_payload(spark, sf):
    """Ranks of a frame with columns outside the order, some of them pruned."""
    ranked = global_rank(_t(spark, sf, "orders"), [F.desc("o_totalprice"), F.asc("o_orderkey")])
    return ranked.select("rank", "o_orderkey", "o_orderpriority", "o_orderdate")


def _infinite_sql(p: float) -> str:
    q = f"quantile_cont(v, {p})"  # between two equal infinities DuckDB's interpolation is NaN
    return f"round(CASE WHEN isnan({q}) THEN quantile_disc(v, {p}) ELSE {q} END, 4) AS q{int(p * 100)}"


@query(
    "numeric_quartiles_infinite",
    f"""SELECT event_type, {_infinite_sql(0.25)}, {_infinite_sql(0.5)}, {_infinite_sql(0.9)} FROM
  (SELECT event_type, CASE WHEN event_id % 3 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE value END AS v FROM events) x GROUP BY event_type""",
)
def numeric_quartiles_infinite(spark, sf):
    """Quantiles where a third of the values is infinite (V5)."""
    e = _t(spark, sf, "events")
    e = e.withColumn("v", F.when(F.col("event_id") % 3 == 0, F.lit(float("inf"))).otherwise(F.col("value")))
    out = groups.group_quantiles(e, ["event_type"], "v", (0.25, 0.5, 0.9))
    return rnd(out, {"q25": 4, "q50": 4, "q90": 4})


FIVE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_sevenths"]
LI_SEVENTHS_SQL = "(SELECT *, l_extendedprice / 7 AS l_sevenths FROM lineitem)"


def _sevenths(spark, sf):
    return _t(spark, sf, "lineitem").withColumn("l_sevenths", F.col("l_extendedprice") / 7)


@query(
    "rankings_of_five_metrics",
    f"""WITH t AS (SELECT l_returnflag, {', '.join(f'round(sum({m}), 2) AS {m}' for m in FIVE)} FROM {LI_SEVENTHS_SQL} GROUP BY l_returnflag),
u AS ({' UNION ALL '.join(f"SELECT '{m}' AS metric, l_returnflag, {m} AS total FROM t" for m in FIVE)})
SELECT metric, {rank_sql('total DESC, l_returnflag').replace('OVER (', 'OVER (PARTITION BY metric ')} AS rank, l_returnflag, total FROM u""",
)
def rankings_of_five_metrics(spark, sf):
    """All five metrics come back; plain sums of values with more than two decimals."""
    out = engagement.category_rankings(_sevenths(spark, sf), "l_returnflag", FIVE, k=10)
    return rnd(out, {"total": 2})


@query(
    "means_of_five_columns",
    f"""SELECT l_linestatus, count(*) AS row_count,
  {', '.join(f'round(avg({m}), 6) AS {m}_mean, count({m}) AS {m}_count' for m in FIVE)} FROM {LI_SEVENTHS_SQL} GROUP BY l_linestatus""",
)
def means_of_five_columns(spark, sf):
    """The same values with ``exact_scale``: what does not fit is added plainly, not cut."""
    out = engagement.category_means(_sevenths(spark, sf), "l_linestatus", FIVE, exact_scale=SCALE)
    return rnd(out, {f"{m}_mean": 6 for m in FIVE})


@query(
    "grouping_candidates_lineitem",
    _over("(SELECT * FROM lineitem)", _candidates_sql([(0, "l_orderkey"), (1, "l_returnflag"), (2, "l_linestatus"), (3, "l_shipdate")])),
)
def grouping_candidates_lineitem(spark, sf):
    """Decided on exact counts: the order key and the ship date have too many values."""
    return groups.grouping_candidates(_t(spark, sf, "lineitem"), ["l_orderkey", "l_returnflag", "l_linestatus", "l_shipdate"])


@query(
    "grouping_candidates_first_rows",
    _over(
        "(SELECT * FROM orders ORDER BY o_orderkey LIMIT 15)",
        _candidates_sql([(0, "o_custkey"), (1, "o_orderstatus"), (2, "o_orderpriority"), (3, "o_orderkey")]),
    ),
)
def grouping_candidates_first_rows(spark, sf):
    """The rule applied to the first rows only, as an option."""
    o = _t(spark, sf, "orders")
    return groups.grouping_candidates(
        o, ["o_custkey", "o_orderstatus", "o_orderpriority", "o_orderkey"], sample_rows=15, order_by="o_orderkey"
    )


LI_DUPLICATED_SQL = "(SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_orderkey % 4 = 0)"


@query(
    "dedup_whole_rows",
    f"""SELECT CAST(count(*) AS BIGINT) AS rows_before, (SELECT count(*) FROM (SELECT DISTINCT * FROM {LI_DUPLICATED_SQL} a) b) AS rows_after,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {LI_DUPLICATED_SQL} a) b) AS duplicates_removed FROM {LI_DUPLICATED_SQL} c""",
)
def dedup_whole_rows(spark, sf):
    """U1 and U3 over all columns of a table that holds full-row duplicates."""
    li = _t(spark, sf, "lineitem")
    return clean.dedup_counts(li.unionByName(li.where(F.col("l_orderkey") % 4 == 0)))
