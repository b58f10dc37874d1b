"""Registered queries: each library operator run over the driver's tables,
paired with equivalent DuckDB SQL (the correctness oracle).

Every query reads whole tables. Nulls, null tokens and bad cells are injected
deterministically from a key (``CASE WHEN key % m = 0 ...``), written the same
way in the Spark query and in the SQL, because the generated tables hold none.
Sums and means use the library's ``exact_scale=2`` (decimal accumulation,
double result) and the SQL does the same, so both sides produce the same bits
whatever the summation order; deviations and quantiles, whose algorithms
differ between engines, are rounded to 4 places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.functions.display import composite_label, format_stat, key_label, short_label
from tablelens.functions.json import json_canonical, json_kind
from tablelens.operators import clean, engagement, groups, profile, roles
from tablelens.session import shared_dir
from tablelens.sources.delimited import read_table, write_delimited
from tablelens.sources.tables import read_parquet
from tablelens.streaming import read_stream, run_available, stream_engagement, stream_group_sizes

QueryFn = Callable[[SparkSession, str], DataFrame]
CATALOGUE: dict[str, tuple[QueryFn, str | None]] = {}


def query(name: str, sql: str | None):
    def register(fn: QueryFn) -> QueryFn:
        CATALOGUE[name] = (fn, sql)
        return fn

    return register


# ---------------------------------------------------------------- helpers


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_parquet(spark, sf, name)


def inj(c: str, key: str, m: int) -> Column:
    """NULL where ``key % m == 0``: deterministic missing values."""
    return F.when(F.col(key) % m == 0, F.lit(None)).otherwise(F.col(c)).alias(c)


def sinj(c: str, key: str, m: int) -> str:
    return f"CASE WHEN {key} % {m} = 0 THEN NULL ELSE {c} END"


def rnd(d: DataFrame, cols: dict[str, int]) -> DataFrame:
    return d.select(*[F.round(c, cols[c]).alias(c) if c in cols else F.col(c) for c in d.columns])


LI_METRICS = ["l_quantity", "l_extendedprice", "l_tax"]


def _li_injected(spark: SparkSession, sf: str) -> DataFrame:
    li = _t(spark, sf, "lineitem")
    return li.select(
        "l_orderkey",
        "l_suppkey",
        "l_partkey",
        "l_returnflag",
        "l_linestatus",
        inj("l_quantity", "l_orderkey", 7),
        inj("l_extendedprice", "l_orderkey", 11),
        inj("l_discount", "l_orderkey", 5),
        inj("l_tax", "l_orderkey", 13),
    )


LI_INJECTED_SQL = f"""(SELECT l_orderkey, l_suppkey, l_partkey, l_returnflag, l_linestatus,
  {sinj('l_quantity', 'l_orderkey', 7)} AS l_quantity,
  {sinj('l_extendedprice', 'l_orderkey', 11)} AS l_extendedprice,
  {sinj('l_discount', 'l_orderkey', 5)} AS l_discount,
  {sinj('l_tax', 'l_orderkey', 13)} AS l_tax
  FROM lineitem)"""


def _orders_injected(spark: SparkSession, sf: str) -> DataFrame:
    o = _t(spark, sf, "orders")
    return o.select(
        "o_orderkey",
        inj("o_custkey", "o_orderkey", 11),
        "o_orderstatus",
        inj("o_totalprice", "o_orderkey", 7),
        "o_orderdate",
        inj("o_orderpriority", "o_orderkey", 5),
    )


ORDERS_INJECTED_SQL = f"""(SELECT o_orderkey, {sinj('o_custkey', 'o_orderkey', 11)} AS o_custkey,
  o_orderstatus, {sinj('o_totalprice', 'o_orderkey', 7)} AS o_totalprice, o_orderdate,
  {sinj('o_orderpriority', 'o_orderkey', 5)} AS o_orderpriority FROM orders)"""


def xsum(c: str) -> str:
    """Exact sum of 2-decimal values, as a double (the library's ``exact_scale=2``)."""
    return f"CAST(sum(CAST({c} AS DECIMAL(18,2))) AS DOUBLE)"


def xmean(c: str) -> str:
    return f"({xsum(c)} / NULLIF(count({c}), 0))"


SCALE = 2  # values of the driver's tables carry at most two decimals


def rank_sql(order: str) -> str:
    return f"CAST(row_number() OVER (ORDER BY {order}) AS BIGINT)"


# ------------------------------------------------------------- engagement


def _rankings_sql(table: str, key: str, metrics: list[str], k: int) -> str:
    sums = ", ".join(f"coalesce({xsum(m)}, 0) AS {m}" for m in metrics)
    unions = " UNION ALL ".join(f"SELECT '{m}' AS metric, {key}, {m} AS total FROM t" for m in metrics)
    return f"""WITH t AS (SELECT {key}, {sums} FROM {table} GROUP BY {key}),
u AS ({unions}),
r AS (SELECT metric, CAST(row_number() OVER (PARTITION BY metric ORDER BY total DESC, {key} ASC NULLS FIRST) AS BIGINT) AS rank, {key}, total FROM u)
SELECT metric, rank, {key}, total FROM r WHERE rank <= {k}"""


def _page_sql(table: str, key: str, metrics: list[str], k: int) -> str:
    sums = ", ".join(f"coalesce({xsum(m)}, 0) AS {m}" for m in metrics)
    total = " + ".join(metrics)
    rounded = ", ".join(metrics)
    order = f"total_engagement DESC, {key} ASC NULLS FIRST"
    return f"""WITH t AS (SELECT {key}, {sums} FROM {table} GROUP BY {key}),
top AS (SELECT *, {total} AS total_engagement FROM t ORDER BY {order} LIMIT {k})
SELECT {rank_sql(order)} AS rank, {key}, {rounded}, total_engagement FROM top"""


@query("page_engagement_top10", _page_sql("lineitem", "l_suppkey", LI_METRICS, 10))
def page_engagement_top10(spark, sf):
    return engagement.page_engagement(_t(spark, sf, "lineitem"), "l_suppkey", LI_METRICS, k=10, exact_scale=SCALE)


@query("page_engagement_injected", _page_sql(LI_INJECTED_SQL, "l_suppkey", LI_METRICS, 10))
def page_engagement_injected(spark, sf):
    return engagement.page_engagement(_li_injected(spark, sf), "l_suppkey", LI_METRICS, k=10, exact_scale=SCALE)


@query("category_rankings_top5", _rankings_sql("lineitem", "l_returnflag", LI_METRICS, 5))
def category_rankings_top5(spark, sf):
    return engagement.category_rankings(
        _t(spark, sf, "lineitem"), "l_returnflag", LI_METRICS, k=5, exact_scale=SCALE
    )


@query("category_rankings_part_top5", _rankings_sql(LI_INJECTED_SQL, "l_partkey", LI_METRICS, 5))
def category_rankings_part_top5(spark, sf):
    return engagement.category_rankings(_li_injected(spark, sf), "l_partkey", LI_METRICS, k=5, exact_scale=SCALE)


def _share_sql(table: str, key: str) -> str:
    order = f"count DESC, {key} ASC NULLS FIRST"
    return f"""WITH c AS (SELECT {key}, count(*) AS count FROM {table} GROUP BY {key})
SELECT {rank_sql(order)} AS rank, {key}, count,
  round(100.0 * count / (SELECT count(*) FROM {table}), 1) AS pct FROM c"""


@query("category_share", _share_sql("orders", "o_orderpriority"))
def category_share(spark, sf):
    return engagement.category_share(_t(spark, sf, "orders"), "o_orderpriority")


@query("category_share_with_null", _share_sql(ORDERS_INJECTED_SQL, "o_orderpriority"))
def category_share_with_null(spark, sf):
    return engagement.category_share(_orders_injected(spark, sf), "o_orderpriority")


@query("category_share_customers", _share_sql("orders", "o_custkey"))
def category_share_customers(spark, sf):
    return engagement.category_share(_t(spark, sf, "orders"), "o_custkey")


@query(
    "category_means",
    f"""SELECT o_orderstatus, count(*) AS row_count,
  {xmean('o_totalprice')} AS o_totalprice_mean, count(o_totalprice) AS o_totalprice_count,
  {xmean('o_custkey')} AS o_custkey_mean, count(o_custkey) AS o_custkey_count
FROM {ORDERS_INJECTED_SQL} GROUP BY o_orderstatus""",
)
def category_means(spark, sf):
    return engagement.category_means(
        _orders_injected(spark, sf), "o_orderstatus", ["o_totalprice", "o_custkey"], exact_scale=SCALE
    )


def _engagement_sql(key: str, rank_by: str, k: int = 10) -> str:
    measure = "total_engagement" if rank_by == "total" else "posts"
    order = f"{measure} DESC, {key} ASC NULLS FIRST"
    return f"""WITH e AS (SELECT {key}, coalesce(l_quantity, 0) + coalesce(l_extendedprice, 0) + coalesce(l_tax, 0) AS te
  FROM {LI_INJECTED_SQL}),
g AS (SELECT {key}, count(*) AS posts, {xsum('te')} AS total_engagement, {xmean('te')} AS avg_engagement
  FROM e GROUP BY {key}),
top AS (SELECT * FROM g ORDER BY {order} LIMIT {k})
SELECT {rank_sql(order)} AS rank, {key}, posts, total_engagement, avg_engagement FROM top"""


def _engagement(spark, sf, key, rank_by):
    return engagement.engagement_by_group(
        _li_injected(spark, sf), key, LI_METRICS, k=10, rank_by=rank_by, exact_scale=SCALE
    )


@query("engagement_by_group_total", _engagement_sql("l_returnflag", "total"))
def engagement_by_group_total(spark, sf):
    return _engagement(spark, sf, "l_returnflag", "total")


@query("engagement_by_group_posts", _engagement_sql("l_returnflag", "posts"))
def engagement_by_group_posts(spark, sf):
    return _engagement(spark, sf, "l_returnflag", "posts")


@query("engagement_by_supplier", _engagement_sql("l_suppkey", "total"))
def engagement_by_supplier(spark, sf):
    return _engagement(spark, sf, "l_suppkey", "total")


# ----------------------------------------------------------------- groups

EVENTS_NULL_USER_SQL = f"(SELECT event_id, {sinj('user_id', 'event_id', 7)} AS user_id, event_type, value FROM events)"


def _events_null_user(spark, sf):
    return _t(spark, sf, "events").select("event_id", inj("user_id", "event_id", 7), "event_type", "value")


@query("group_sizes_one_key", "SELECT user_id, count(*) AS size FROM events GROUP BY user_id")
def group_sizes_one_key(spark, sf):
    return groups.group_sizes(_t(spark, sf, "events"), ["user_id"])


@query(
    "group_sizes_two_keys",
    "SELECT user_id, event_type, count(*) AS size FROM events GROUP BY user_id, event_type",
)
def group_sizes_two_keys(spark, sf):
    return groups.group_sizes(_t(spark, sf, "events"), ["user_id", "event_type"])


@query("group_sizes_keep_null", f"SELECT user_id, count(*) AS size FROM {EVENTS_NULL_USER_SQL} GROUP BY user_id")
def group_sizes_keep_null(spark, sf):
    return groups.group_sizes(_events_null_user(spark, sf), ["user_id"])


@query(
    "group_sizes_drop_null",
    f"SELECT user_id, count(*) AS size FROM {EVENTS_NULL_USER_SQL} WHERE user_id IS NOT NULL GROUP BY user_id",
)
def group_sizes_drop_null(spark, sf):
    return groups.group_sizes(_events_null_user(spark, sf), ["user_id"], drop_null_keys=True)


@query(
    "group_sizes_ranked",
    f"""SELECT {rank_sql('size DESC, user_id ASC NULLS FIRST, event_type ASC NULLS FIRST')} AS rank,
  user_id, event_type, size
FROM (SELECT user_id, event_type, count(*) AS size FROM {EVENTS_NULL_USER_SQL} GROUP BY user_id, event_type) s""",
)
def group_sizes_ranked(spark, sf):
    """All groups of a composite key ranked by size (NULL keys included)."""
    return groups.ranked_group_sizes(_events_null_user(spark, sf), ["user_id", "event_type"])


@query(
    "group_sizes_multi",
    f"""SELECT CASE GROUPING(event_type, user_id) WHEN 1 THEN 'event_type'
    WHEN 0 THEN 'user_id,event_type' WHEN 2 THEN 'user_id' END AS key_set,
  event_type, user_id, CAST(GROUPING(event_type, user_id) AS BIGINT) AS grouping_id, count(*) AS size
FROM {EVENTS_NULL_USER_SQL} GROUP BY GROUPING SETS ((event_type), (user_id, event_type), (user_id))""",
)
def group_sizes_multi(spark, sf):
    out = groups.group_sizes_multi(
        _events_null_user(spark, sf), [["event_type"], ["user_id", "event_type"], ["user_id"]]
    )
    return out.withColumn("grouping_id", F.col("grouping_id").cast("long"))


@query(
    "group_size_stats",
    """WITH s AS (SELECT o_custkey, count(*) AS size FROM orders GROUP BY o_custkey)
SELECT count(*) AS group_count, CAST(sum(size) AS BIGINT) AS row_count,
  round(avg(size), 4) AS mean_size, round(stddev_samp(size), 4) AS std_size,
  min(size) AS min_size, max(size) AS max_size,
  round(quantile_cont(size, 0.25), 4) AS q25, round(quantile_cont(size, 0.5), 4) AS q50,
  round(quantile_cont(size, 0.75), 4) AS q75 FROM s""",
)
def group_size_stats(spark, sf):
    out = groups.group_size_stats(_t(spark, sf, "orders"), ["o_custkey"])
    return rnd(out, {"mean_size": 4, "std_size": 4, "q25": 4, "q50": 4, "q75": 4})


def _top_groups_sql(table: str, keys: list[str], k: int) -> str:
    order = "size DESC, " + ", ".join(f"{c} ASC NULLS FIRST" for c in keys)
    label = f"coalesce(CAST({keys[0]} AS VARCHAR), 'None')"
    if len(keys) > 1:
        label = f"{label} || '+{len(keys) - 1}more'"
    keylist = ", ".join(keys)
    return f"""WITH s AS (SELECT {keylist}, count(*) AS size FROM {table} GROUP BY {keylist} ORDER BY {order} LIMIT {k})
SELECT {rank_sql(order)} AS rank, {keylist}, size, {label} AS label FROM s"""


@query("top_groups_10", _top_groups_sql("events", ["user_id"], 10))
def top_groups_10(spark, sf):
    return groups.top_groups(_t(spark, sf, "events"), ["user_id"], k=10)


@query("top_groups_two_keys", _top_groups_sql("events", ["user_id", "event_type"], 10))
def top_groups_two_keys(spark, sf):
    return groups.top_groups(_t(spark, sf, "events"), ["user_id", "event_type"], k=10)


@query("top_groups_null_key", _top_groups_sql(EVENTS_NULL_USER_SQL, ["user_id"], 10))
def top_groups_null_key(spark, sf):
    return groups.top_groups(_events_null_user(spark, sf), ["user_id"], k=10)


DRILL_COLS = ["l_quantity", "l_extendedprice", "l_discount"]
LI_HOT_KEY_SQL = f"(SELECT {sinj('l_suppkey', 'l_orderkey', 3)} AS l_suppkey, l_quantity, l_extendedprice, l_discount FROM lineitem)"


def _li_hot_key(spark, sf):
    # One third of all rows share the NULL key: the skewed-group case.
    return _t(spark, sf, "lineitem").select(
        inj("l_suppkey", "l_orderkey", 3), "l_quantity", "l_extendedprice", "l_discount"
    )


def _drilldown_sql(table: str, key: str, cols: list[str], k: int) -> str:
    aggs = ", ".join(
        f"count({c}) AS n{i}, {xmean(c)} AS a{i}, min({c}) AS lo{i}, max({c}) AS hi{i}" for i, c in enumerate(cols)
    )
    order = f"size DESC, {key} ASC NULLS FIRST"
    parts = " UNION ALL ".join(
        f"SELECT rank, {key}, size, '{c}' AS column_name, {i} AS position, n{i} AS count, "
        f"a{i} AS mean, lo{i} AS min, hi{i} AS max FROM r"
        for i, c in enumerate(cols)
    )
    return f"""WITH g AS (SELECT {key}, count(*) AS size, {aggs} FROM {table} GROUP BY {key} ORDER BY {order} LIMIT {k}),
r AS (SELECT *, {rank_sql(order)} AS rank FROM g)
{parts}"""


def _drill(d, method):
    return groups.top_group_drilldown(d, ["l_suppkey"], DRILL_COLS, k=3, method=method, exact_scale=SCALE)


@query("top_group_drilldown", _drilldown_sql("lineitem", "l_suppkey", DRILL_COLS, 3))
def top_group_drilldown(spark, sf):
    return _drill(_t(spark, sf, "lineitem"), "single_pass")


@query("top_group_drilldown_semijoin", _drilldown_sql("lineitem", "l_suppkey", DRILL_COLS, 3))
def top_group_drilldown_semijoin(spark, sf):
    return _drill(_t(spark, sf, "lineitem"), "semi_join")


@query("top_group_drilldown_null_key", _drilldown_sql(LI_HOT_KEY_SQL, "l_suppkey", DRILL_COLS, 3))
def top_group_drilldown_null_key(spark, sf):
    return _drill(_li_hot_key(spark, sf), "single_pass")


@query("top_group_drilldown_null_key_semijoin", _drilldown_sql(LI_HOT_KEY_SQL, "l_suppkey", DRILL_COLS, 3))
def top_group_drilldown_null_key_semijoin(spark, sf):
    return _drill(_li_hot_key(spark, sf), "semi_join")


def _grouped_stats_sql(table: str, key: str, cols: list[str], k: int) -> str:
    aggs = ", ".join(
        f"count({c}) AS n{i}, {xmean(c)} AS a{i}, min({c}) AS lo{i}, max({c}) AS hi{i}" for i, c in enumerate(cols)
    )
    unions = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {i} AS position, {key}, n{i} AS count, a{i} AS mean, lo{i} AS min, hi{i} AS max FROM g"
        for i, c in enumerate(cols)
    )
    return f"""WITH g AS (SELECT {key}, {aggs} FROM {table} GROUP BY {key}),
u AS ({unions}),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY column_name ORDER BY count DESC, {key} ASC NULLS FIRST) AS BIGINT) AS rank
  FROM u WHERE count > 0)
SELECT column_name, position, rank, {key}, count, mean, min, max FROM r WHERE rank <= {k}"""


@query("grouped_numeric_stats", _grouped_stats_sql(LI_INJECTED_SQL, "l_suppkey", LI_METRICS, 10))
def grouped_numeric_stats(spark, sf):
    return groups.grouped_numeric_stats(_li_injected(spark, sf), ["l_suppkey"], LI_METRICS, k=10, exact_scale=SCALE)


@query("grouped_numeric_stats_hot_key", _grouped_stats_sql(LI_HOT_KEY_SQL, "l_suppkey", DRILL_COLS, 10))
def grouped_numeric_stats_hot_key(spark, sf):
    return groups.grouped_numeric_stats(_li_hot_key(spark, sf), ["l_suppkey"], DRILL_COLS, k=10, exact_scale=SCALE)


@query(
    "first_groups_sample",
    f"""WITH g AS (SELECT o_custkey, min(o_orderkey) AS first_seen, count(*) AS row_count,
    {xmean('o_totalprice')} AS m, count(o_totalprice) AS o_totalprice_count
  FROM {ORDERS_INJECTED_SQL} GROUP BY o_custkey ORDER BY first_seen ASC, o_custkey ASC NULLS FIRST LIMIT 10)
SELECT {rank_sql('first_seen ASC, o_custkey ASC NULLS FIRST')} AS rank, o_custkey, first_seen, row_count,
  m AS o_totalprice_mean, o_totalprice_count FROM g""",
)
def first_groups_sample(spark, sf):
    return groups.first_groups(
        _orders_injected(spark, sf), ["o_custkey"], "o_orderkey", k=10, cols=["o_totalprice"], exact_scale=SCALE
    )


@query(
    "first_combinations",
    f"""WITH g AS (SELECT user_id, event_type, min(event_id) AS first_seen, count(*) AS row_count,
    {xmean('value')} AS m, count(value) AS value_count
  FROM events GROUP BY user_id, event_type
  ORDER BY first_seen ASC, user_id ASC NULLS FIRST, event_type ASC NULLS FIRST LIMIT 10)
SELECT {rank_sql('first_seen ASC, user_id ASC NULLS FIRST, event_type ASC NULLS FIRST')} AS rank,
  user_id, event_type, first_seen, row_count, m AS value_mean, value_count FROM g""",
)
def first_combinations(spark, sf):
    return groups.first_groups(
        _t(spark, sf, "events"), ["user_id", "event_type"], "event_id", k=10, cols=["value"], exact_scale=SCALE
    )


@query("distinct_keys", "SELECT DISTINCT user_id, event_type FROM events")
def distinct_keys(spark, sf):
    return clean.distinct_keys(_t(spark, sf, "events"), ["user_id", "event_type"])


@query(
    "grouping_candidates",
    """WITH u AS (
  SELECT 'o_orderstatus' AS column_name, 0 AS position, count(DISTINCT o_orderstatus) AS unique_count FROM orders
  UNION ALL SELECT 'o_orderdate', 1, count(DISTINCT CAST(o_orderdate AS VARCHAR)) FROM orders
  UNION ALL SELECT 'o_orderpriority', 2, count(DISTINCT o_orderpriority) FROM orders)
SELECT column_name, position, unique_count, CAST(row_number() OVER (ORDER BY unique_count, position) AS BIGINT) AS choice
FROM u WHERE unique_count BETWEEN 2 AND 20""",
)
def grouping_candidates(spark, sf):
    o = _t(spark, sf, "orders")
    text = list(roles.classify_by_schema(o).text)
    return groups.grouping_candidates(o, text, exclude=["o_orderkey", "o_custkey"])


@query(
    "group_quantiles",
    """SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 4) AS q25,
  round(quantile_cont(l_extendedprice, 0.5), 4) AS q50, round(quantile_cont(l_extendedprice, 0.75), 4) AS q75
FROM lineitem GROUP BY l_returnflag""",
)
def group_quantiles(spark, sf):
    out = groups.group_quantiles(_t(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice")
    return rnd(out, {"q25": 4, "q50": 4, "q75": 4})


@query(
    "group_quantiles_distributed",
    f"""SELECT {sinj('l_suppkey', 'l_orderkey', 3)} AS l_suppkey,
  round(quantile_cont(l_extendedprice, 0.25), 4) AS q25, round(quantile_cont(l_extendedprice, 0.5), 4) AS q50,
  round(quantile_cont(l_extendedprice, 0.75), 4) AS q75
FROM lineitem GROUP BY 1""",
)
def group_quantiles_distributed(spark, sf):
    """Per-supplier quartiles with a hot NULL group holding a third of all rows."""
    d = _li_hot_key(spark, sf)
    out = groups.group_quantiles(d, ["l_suppkey"], "l_extendedprice")
    return rnd(out, {"q25": 4, "q50": 4, "q75": 4})


# ---------------------------------------------------------------- profile


def _overview_sql(table: str, cols: list[str], n_numeric: int, n_text: int) -> str:
    nulls = [f"count(*) FILTER (WHERE {c} IS NULL)" for c in cols]
    missing = " + ".join(nulls)
    with_nulls = " + ".join(f"CAST(({n}) > 0 AS BIGINT)" for n in nulls)
    return f"""SELECT count(*) AS row_count, CAST({len(cols)} AS BIGINT) AS column_count,
  CAST({n_numeric} AS BIGINT) AS numeric_columns, CAST({n_text} AS BIGINT) AS text_columns,
  CAST({missing} AS BIGINT) AS missing_cells,
  round(100.0 * ({missing}) / (count(*) * {len(cols)}), 1) AS missing_pct,
  CAST({with_nulls} AS BIGINT) AS columns_with_nulls FROM {table}"""


ORDERS_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query("dataset_overview", _overview_sql(ORDERS_INJECTED_SQL, ORDERS_COLS, 3, 3))
def dataset_overview(spark, sf):
    d = _orders_injected(spark, sf)
    return profile.dataset_overview(d, roles.classify_by_schema(d))


def _null_counts_sql(table: str, cols: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {i} AS position, count(*) AS row_count, count({c}) AS non_null, "
        f"count(*) - count({c}) AS missing FROM {table}"
        for i, c in enumerate(cols)
    )


@query("null_counts_per_column", _null_counts_sql(ORDERS_INJECTED_SQL, ORDERS_COLS))
def null_counts_per_column(spark, sf):
    return profile.null_counts(_orders_injected(spark, sf))


@query(
    "null_column_count",
    f"""SELECT CAST(count(*) FILTER (WHERE missing > 0) AS BIGINT) AS columns_with_nulls, count(*) AS column_count
FROM ({_null_counts_sql(ORDERS_INJECTED_SQL, ORDERS_COLS)}) x""",
)
def null_column_count(spark, sf):
    return profile.null_column_count(_orders_injected(spark, sf))


PROFILE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _numeric_profile_sql(table: str, cols: list[str], std: str, quartiles: bool = False) -> str:
    parts = []
    for i, c in enumerate(cols):
        q = ""
        if quartiles:
            q = "".join(f", round(quantile_cont({c}, {p}), 4) AS q{int(p * 100)}" for p in (0.25, 0.5, 0.75))
        parts.append(
            f"SELECT '{c}' AS column_name, {i} AS position, count({c}) AS count, count(*) - count({c}) AS missing, "
            f"{xmean(c)} AS mean, round({std}({c}), 4) AS std, CAST(min({c}) AS DOUBLE) AS min, "
            f"CAST(max({c}) AS DOUBLE) AS max{q} FROM {table}"
        )
    return " UNION ALL ".join(parts)


@query("numeric_profile_sample", _numeric_profile_sql(LI_INJECTED_SQL, PROFILE_COLS, "stddev_samp"))
def numeric_profile_sample(spark, sf):
    out = profile.numeric_profile(_li_injected(spark, sf), PROFILE_COLS, ddof=1, exact_scale=SCALE)
    return rnd(out, {"std": 4})


@query("numeric_profile_population", _numeric_profile_sql(LI_INJECTED_SQL, PROFILE_COLS, "stddev_pop"))
def numeric_profile_population(spark, sf):
    out = profile.numeric_profile(_li_injected(spark, sf), PROFILE_COLS, ddof=0, exact_scale=SCALE)
    return rnd(out, {"std": 4})


@query("numeric_quartiles", _numeric_profile_sql(LI_INJECTED_SQL, PROFILE_COLS, "stddev_samp", quartiles=True))
def numeric_quartiles(spark, sf):
    out = profile.numeric_profile(
        _li_injected(spark, sf), PROFILE_COLS, quantile_probs=(0.25, 0.5, 0.75), exact_scale=SCALE
    )
    return rnd(out, {"std": 4, "q25": 4, "q50": 4, "q75": 4})


@query(
    "numeric_quartiles_distributed",
    _numeric_profile_sql(LI_INJECTED_SQL, PROFILE_COLS, "stddev_samp", quartiles=True),
)
def numeric_quartiles_distributed(spark, sf):
    """The name that an earlier method had; quartiles have one method now."""
    return numeric_quartiles(spark, sf)


@query("events_value_quartiles", _numeric_profile_sql("events", ["value"], "stddev_samp", quartiles=True))
def events_value_quartiles(spark, sf):
    out = profile.numeric_profile(
        _t(spark, sf, "events"), ["value"], quantile_probs=(0.25, 0.5, 0.75), exact_scale=SCALE
    )
    return rnd(out, {"std": 4, "q25": 4, "q50": 4, "q75": 4})


def _categorical_sql(table: str, cols: list[str]) -> str:
    parts = []
    for i, c in enumerate(cols):
        parts.append(
            f"""SELECT '{c}' AS column_name, {i} AS position,
  CAST(coalesce(sum(n) FILTER (WHERE v IS NOT NULL), 0) AS BIGINT) AS count,
  CAST(coalesce(sum(n) FILTER (WHERE v IS NULL), 0) AS BIGINT) AS missing,
  count(v) AS unique_count,
  CAST(first(v ORDER BY n DESC, v ASC) FILTER (WHERE v IS NOT NULL) AS VARCHAR) AS top_value,
  CAST(coalesce(max(n) FILTER (WHERE v IS NOT NULL), 0) AS BIGINT) AS top_count
FROM (SELECT {c} AS v, count(*) AS n FROM {table} GROUP BY 1) f{i}"""
        )
    return " UNION ALL ".join(parts)


PART_WITH_NULLS_SQL = f"""(SELECT p_name, {sinj('p_brand', 'p_partkey', 6)} AS p_brand, p_type,
  CAST(NULL AS VARCHAR) AS p_comment FROM part)"""


def _part_with_nulls(spark, sf):
    p = _t(spark, sf, "part")
    return p.select("p_name", inj("p_brand", "p_partkey", 6), "p_type", F.lit(None).cast("string").alias("p_comment"))


@query("categorical_profile", _categorical_sql(PART_WITH_NULLS_SQL, ["p_name", "p_brand", "p_type", "p_comment"]))
def categorical_profile(spark, sf):
    return profile.categorical_profile(_part_with_nulls(spark, sf), ["p_name", "p_brand", "p_type", "p_comment"])


CUSTOMER_INJECTED_SQL = f"""(SELECT c_custkey, c_name, {sinj('c_nationkey', 'c_custkey', 9)} AS c_nationkey,
  c_acctbal, {sinj('c_mktsegment', 'c_custkey', 4)} AS c_mktsegment FROM customer)"""


def _customer_injected(spark, sf):
    c = _t(spark, sf, "customer")
    return c.select(
        "c_custkey", "c_name", inj("c_nationkey", "c_custkey", 9), "c_acctbal", inj("c_mktsegment", "c_custkey", 4)
    )


@query("categorical_profile_customer", _categorical_sql(CUSTOMER_INJECTED_SQL, ["c_name", "c_mktsegment", "c_nationkey"]))
def categorical_profile_customer(spark, sf):
    return profile.categorical_profile(_customer_injected(spark, sf), ["c_name", "c_mktsegment", "c_nationkey"])


@query(
    "distinct_with_null",
    f"""SELECT 'c_mktsegment' AS column_name, 0 AS position,
  CAST(count(DISTINCT c_mktsegment) + max(CASE WHEN c_mktsegment IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS distinct_count
FROM {CUSTOMER_INJECTED_SQL}
UNION ALL SELECT 'c_nationkey', 1,
  CAST(count(DISTINCT c_nationkey) + max(CASE WHEN c_nationkey IS NULL THEN 1 ELSE 0 END) AS BIGINT)
FROM {CUSTOMER_INJECTED_SQL}""",
)
def distinct_with_null(spark, sf):
    return profile.distinct_counts(_customer_injected(spark, sf), ["c_mktsegment", "c_nationkey"], count_null=True)


@query(
    "distinct_without_null",
    f"""SELECT 'c_mktsegment' AS column_name, 0 AS position, count(DISTINCT c_mktsegment) AS distinct_count
FROM {CUSTOMER_INJECTED_SQL}
UNION ALL SELECT 'c_nationkey', 1, count(DISTINCT c_nationkey) FROM {CUSTOMER_INJECTED_SQL}""",
)
def distinct_without_null(spark, sf):
    return profile.distinct_counts(_customer_injected(spark, sf), ["c_mktsegment", "c_nationkey"])


@query(
    "value_counts",
    f"""WITH c AS (SELECT p_brand AS value, count(*) AS count FROM {PART_WITH_NULLS_SQL} WHERE p_brand IS NOT NULL GROUP BY 1)
SELECT value, count, {rank_sql('count DESC, value ASC NULLS FIRST')} AS rank,
  round(100.0 * count / (SELECT count(*) FROM part), 1) AS pct FROM c""",
)
def value_counts(spark, sf):
    return profile.value_counts(_part_with_nulls(spark, sf), "p_brand")


# ------------------------------------------------------------------ clean

TOKENS_INJECTED_SQL = """(SELECT event_id, CASE event_id % 10 WHEN 1 THEN 'NULL' WHEN 2 THEN ' n/a '
  WHEN 3 THEN 'None' WHEN 4 THEN '' WHEN 5 THEN 'nan' WHEN 6 THEN '#N/A' WHEN 7 THEN ' NA '
  WHEN 8 THEN 'undefined' ELSE event_type END AS event_type FROM events)"""


def _tokens_injected(spark, sf):
    e = _t(spark, sf, "events")
    m = F.col("event_id") % 10
    tok = F.col("event_type")
    for val, text in [(1, "NULL"), (2, " n/a "), (3, "None"), (4, ""), (5, "nan"), (6, "#N/A"), (7, " NA "), (8, "undefined")]:
        tok = F.when(m == val, F.lit(text)).otherwise(tok)
    return e.select("event_id", tok.alias("event_type"))


@query(
    "null_tokens_strict",
    f"""SELECT event_id, CASE WHEN trim(event_type) IN ('', 'null', 'NULL', 'None', 'N/A', 'NA') THEN NULL
  ELSE trim(event_type) END AS event_type FROM {TOKENS_INJECTED_SQL}""",
)
def null_tokens_strict(spark, sf):
    return clean.normalise_nulls(_tokens_injected(spark, sf), "strict")


@query(
    "null_tokens_folded",
    f"""SELECT event_id, CASE WHEN lower(trim(event_type)) IN ('', 'na', 'n/a', 'none', 'null', 'nan', '#n/a', '#null!', 'undefined')
  THEN NULL ELSE trim(event_type) END AS event_type FROM {TOKENS_INJECTED_SQL}""",
)
def null_tokens_folded(spark, sf):
    return clean.normalise_nulls(_tokens_injected(spark, sf), "folded")


@query(
    "null_tokens_empty_only",
    f"""SELECT event_id, CASE WHEN trim(event_type) = '' THEN NULL ELSE trim(event_type) END AS event_type
FROM {TOKENS_INJECTED_SQL}""",
)
def null_tokens_empty_only(spark, sf):
    return clean.normalise_nulls(_tokens_injected(spark, sf), "empty")


BAD_NUMBERS = [
    (1, "abc"), (2, " 12 "), (3, "1e5"), (4, "nan"), (5, "1d"), (6, "1_000"),
    (7, "-inf"), (8, ".5"), (9, "3."), (10, "+2"), (11, "1,000"),
]
VALUE_TEXT_SQL = (
    "(SELECT event_id, CASE event_id % 12 "
    + " ".join(f"WHEN {k} THEN '{v}'" for k, v in BAD_NUMBERS)
    + " ELSE CAST(value AS VARCHAR) END AS value FROM events)"
)


def _value_text(spark, sf):
    e = _t(spark, sf, "events")
    m = F.col("event_id") % 12
    v = F.col("value").cast("string")
    for k, text in BAD_NUMBERS:
        v = F.when(m == k, F.lit(text)).otherwise(v)
    return e.select("event_id", v.alias("value"))


GUARD_SQL = r"'(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?)$'"


@query(
    "coerce_numeric",
    f"""WITH p AS (SELECT event_id, CASE WHEN regexp_matches(trim(value), {GUARD_SQL})
    THEN TRY_CAST(trim(value) AS DOUBLE) END AS x FROM {VALUE_TEXT_SQL})
SELECT event_id, CASE WHEN isnan(x) THEN NULL ELSE x END AS value FROM p""",
)
def coerce_numeric(spark, sf):
    return clean.coerce_numeric(_value_text(spark, sf), ["value"])


ORDERDATE_TEXT_SQL = """(SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN 'not a date'
  ELSE CAST(o_orderdate AS VARCHAR) END AS o_orderdate, CAST(o_orderdate AS VARCHAR) AS o_orderdate_clean,
  o_orderstatus FROM orders)"""


def _orderdate_text(spark, sf):
    o = _t(spark, sf, "orders")
    text = F.col("o_orderdate").cast("string")
    return o.select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 50 == 0, F.lit("not a date")).otherwise(text).alias("o_orderdate"),
        text.alias("o_orderdate_clean"),
        "o_orderstatus",
    )


@query(
    "coerce_dates",
    f"""SELECT o_orderkey, coalesce(try_strptime(o_orderdate, '%Y-%m-%d %H:%M:%S'),
  try_strptime(o_orderdate, '%Y-%m-%dT%H:%M:%S'), try_strptime(o_orderdate, '%Y-%m-%d')) AS o_orderdate
FROM {ORDERDATE_TEXT_SQL}""",
)
def coerce_dates(spark, sf):
    """The cell-wise form of S8; ``coerce_dates_all_or_nothing`` has the column-wise one."""
    return clean.parse_timestamps(_orderdate_text(spark, sf).select("o_orderkey", "o_orderdate"), ["o_orderdate"])


def _date_ok_sql(c: str) -> str:
    return (
        f"coalesce(try_strptime({c}, '%Y-%m-%d %H:%M:%S'), try_strptime({c}, '%Y-%m-%dT%H:%M:%S'), "
        f"try_strptime({c}, '%Y-%m-%d'))"
    )


@query(
    "date_parse_report",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count({c}) AS non_null, count({_date_ok_sql(c)}) AS parsed, "
        f"count({c}) > 0 AND count({c}) = count({_date_ok_sql(c)}) AS all_parse FROM {ORDERDATE_TEXT_SQL}"
        for c in ["o_orderdate", "o_orderdate_clean", "o_orderstatus"]
    ),
)
def date_parse_report(spark, sf):
    return clean.date_parse_report(_orderdate_text(spark, sf), ["o_orderdate", "o_orderdate_clean", "o_orderstatus"])


EVENTS_TEXT_SQL = """(SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(ts AS VARCHAR) AS ts,
  CASE WHEN event_id % 5 = 0 THEN 'n/a' ELSE CAST(user_id AS VARCHAR) END AS user_id,
  event_type, CASE WHEN event_id % 20 < 3 THEN 'x' ELSE CAST(value AS VARCHAR) END AS value, props FROM events)"""


def _events_text(spark, sf):
    e = _t(spark, sf, "events")
    return e.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.col("ts").cast("string").alias("ts"),
        F.when(F.col("event_id") % 5 == 0, F.lit("n/a")).otherwise(F.col("user_id").cast("string")).alias("user_id"),
        "event_type",
        F.when(F.col("event_id") % 20 < 3, F.lit("x")).otherwise(F.col("value").cast("string")).alias("value"),
        "props",
    )


EVENTS_TEXT_COLS = ["event_id", "ts", "user_id", "event_type", "value", "props"]


def _classify_sql(threshold: float, inclusive: bool) -> str:
    op = ">=" if inclusive else ">"
    parts = []
    for i, c in enumerate(EVENTS_TEXT_COLS):
        ok = f"regexp_matches(trim({c}), {GUARD_SQL})"
        parts.append(
            f"SELECT '{c}' AS column_name, {i} AS position, count({c}) AS non_null, "
            f"count(*) FILTER (WHERE {ok}) AS numeric_count FROM {EVENTS_TEXT_SQL}"
        )
    union = " UNION ALL ".join(parts)
    return f"""WITH r AS ({union})
SELECT column_name, position, non_null, numeric_count, CAST(numeric_count AS DOUBLE) / non_null AS ratio,
  CASE WHEN non_null > 0 AND CAST(numeric_count AS DOUBLE) / non_null {op} {threshold} THEN 'numeric' ELSE 'text' END AS role
FROM r"""


@query("classify_unanimous", _classify_sql(1.0, True))
def classify_unanimous(spark, sf):
    return roles.role_table(_events_text(spark, sf), threshold=1.0, inclusive=True)


@query("classify_ratio_inclusive", _classify_sql(0.8, True))
def classify_ratio_inclusive(spark, sf):
    return roles.role_table(_events_text(spark, sf), threshold=0.8, inclusive=True)


@query("classify_ratio", _classify_sql(0.8, False))
def classify_ratio(spark, sf):
    return roles.role_table(_events_text(spark, sf), threshold=0.8, inclusive=False)


@query("dedup_exact", "SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem")
def dedup_exact(spark, sf):
    return clean.dedup(_t(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity"))


@query(
    "dedup_counts",
    """SELECT CAST(count(*) AS BIGINT) AS rows_before,
  (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem) x) AS rows_after,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem) y) AS duplicates_removed
FROM lineitem""",
)
def dedup_counts(spark, sf):
    return clean.dedup_counts(_t(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity"))


@query(
    "dedup_normalised",
    f"""SELECT DISTINCT coalesce({sinj('l_returnflag', 'l_orderkey', 7)}, '') AS l_returnflag,
  coalesce(CASE WHEN l_orderkey % 5 = 0 THEN '' ELSE l_linestatus END, '') AS l_linestatus,
  coalesce(CAST(l_quantity AS VARCHAR), '') AS l_quantity FROM lineitem""",
)
def dedup_normalised(spark, sf):
    li = _t(spark, sf, "lineitem")
    d = li.select(
        inj("l_returnflag", "l_orderkey", 7),
        F.when(F.col("l_orderkey") % 5 == 0, F.lit("")).otherwise(F.col("l_linestatus")).alias("l_linestatus"),
        F.col("l_quantity").cast("string").alias("l_quantity"),
    )
    return clean.dedup_normalised(d)


PROPS_SQL = """(SELECT event_id, CASE event_id % 10 WHEN 1 THEN '{}' WHEN 2 THEN '[]' WHEN 3 THEN ''
  WHEN 4 THEN '{bad' WHEN 5 THEN 'plain' WHEN 6 THEN '[1, 2]' ELSE props END AS props FROM events)"""


def _props(spark, sf):
    e = _t(spark, sf, "events")
    m = F.col("event_id") % 10
    p = F.col("props")
    for k, text in [(1, "{}"), (2, "[]"), (3, ""), (4, "{bad"), (5, "plain"), (6, "[1, 2]")]:
        p = F.when(m == k, F.lit(text)).otherwise(p)
    return e.select("event_id", p.alias("props"))


@query(
    "json_normalise",
    f"""SELECT event_id, CASE WHEN props IN ('', '{{}}', '[]') THEN NULL ELSE props END AS props,
  CASE WHEN props IS NULL OR props IN ('', '{{}}', '[]') THEN 'null'
       WHEN NOT (contains(props, '{{') OR contains(props, '[')) THEN 'text'
       WHEN json_valid(props) THEN 'json' ELSE 'invalid' END AS props_kind
FROM {PROPS_SQL}""",
)
def json_normalise(spark, sf):
    d = _props(spark, sf)
    out = clean.normalise_json(d, ["props"])
    return out.withColumn("props_kind", json_kind(F.col("props")))


@query(
    "json_variant",
    f"""SELECT event_id, CASE WHEN props IN ('', '{{}}', '[]') THEN NULL
  WHEN (contains(props, '{{') OR contains(props, '[')) AND json_valid(props) THEN CAST(json(props) AS VARCHAR)
  ELSE props END AS props_json FROM {PROPS_SQL}""",
)
def json_variant(spark, sf):
    return _props(spark, sf).select("event_id", json_canonical(F.col("props")).alias("props_json"))


# ------------------------------------------------------------ sources / io


@query(
    "csv_roundtrip_sniff",
    """SELECT CAST(c_custkey AS DOUBLE) AS c_custkey, c_name, CAST(c_nationkey AS DOUBLE) AS c_nationkey,
  c_acctbal, c_mktsegment FROM customer""",
)
def csv_roundtrip_sniff(spark, sf):
    """Stage customer as TSV in the shared folder, read it back with sniffing."""
    target = shared_dir(spark, "customer-tsv")
    write_delimited(_t(spark, sf, "customer"), target, sep="\t")
    d = read_table(spark, target)
    d = clean.normalise_nulls(d, "empty")
    return clean.coerce_numeric(d, ["c_custkey", "c_nationkey", "c_acctbal"])


@query(
    "format_labels",
    f"""SELECT c_custkey,
  CASE WHEN length(c_name) > 10 THEN left(c_name, 10) || '...' ELSE c_name END AS name_label,
  CASE WHEN c_acctbal IS NULL OR isnan(c_acctbal) THEN 'None'
       WHEN c_acctbal = floor(c_acctbal) THEN format('{{:,.0f}}', c_acctbal)
       ELSE format('{{:,.2f}}', c_acctbal) END AS acctbal_text,
  coalesce(c_mktsegment, 'None') AS segment_label,
  coalesce(CAST(c_nationkey AS VARCHAR), 'None') || '+1more' AS key_label
FROM {CUSTOMER_INJECTED_SQL}""",
)
def format_labels(spark, sf):
    c = _customer_injected(spark, sf)
    return c.select(
        "c_custkey",
        short_label("c_name", 10).alias("name_label"),
        format_stat("c_acctbal").alias("acctbal_text"),
        key_label("c_mktsegment").alias("segment_label"),
        composite_label(["c_nationkey", "c_custkey"]).alias("key_label"),
    )


# ---------------------------------------------------------------- analyses


FOLDED_SQL = "('', 'na', 'n/a', 'none', 'null', 'nan', '#n/a', '#null!', 'undefined')"
EVENTS_FOLDED_SQL = f"""(SELECT DISTINCT event_id, ts, user_id,
  CASE WHEN lower(trim(event_type)) IN {FOLDED_SQL} THEN NULL ELSE trim(event_type) END AS event_type, value,
  CASE WHEN lower(trim(props)) IN {FOLDED_SQL} THEN NULL ELSE trim(props) END AS props FROM events)"""


@query(
    "tweets_analysis_overview",
    _overview_sql(EVENTS_FOLDED_SQL, ["event_id", "ts", "user_id", "event_type", "value", "props"], 3, 3).replace(
        f" FROM {EVENTS_FOLDED_SQL}",
        f", CAST((SELECT count(*) FROM events) - count(*) AS BIGINT) AS duplicates_removed FROM {EVENTS_FOLDED_SQL}",
    ),
)
def tweets_analysis_overview(spark, sf):
    from tablelens.plans.reports import tweets_report

    return tweets_report(_t(spark, sf, "events"))["overview"]


# ------------------------------------------------- typing on prefix samples


def _prefix_classify_sql(sample_values: int | None, sample_rows: int | None) -> str:
    parts = []
    for i, c in enumerate(EVENTS_TEXT_COLS):
        ok = f"regexp_matches(trim(v), {GUARD_SQL})"
        if sample_values:
            src = (
                f"(SELECT {c} AS v, row_number() OVER (ORDER BY CAST(event_id AS BIGINT)) AS rn "
                f"FROM {EVENTS_TEXT_SQL} WHERE {c} IS NOT NULL) s{i} WHERE rn <= {sample_values}"
            )
        else:
            src = f"(SELECT {c} AS v FROM {EVENTS_TEXT_SQL} ORDER BY CAST(event_id AS BIGINT) LIMIT {sample_rows}) s{i}"
        parts.append(
            f"SELECT '{c}' AS column_name, {i} AS position, count(v) AS non_null, "
            f"count(*) FILTER (WHERE {ok}) AS numeric_count FROM {src}"
        )
    return f"""WITH r AS ({" UNION ALL ".join(parts)})
SELECT column_name, position, non_null, numeric_count,
  CASE WHEN non_null > 0 THEN CAST(numeric_count AS DOUBLE) / non_null END AS ratio,
  CASE WHEN non_null > 0 AND CAST(numeric_count AS DOUBLE) / non_null >= 1.0 THEN 'numeric' ELSE 'text' END AS role
FROM r"""


@query("classify_first_values", _prefix_classify_sql(100, None))
def classify_first_values(spark, sf):
    """Unanimous typing over the first 100 non-null values of each column."""
    return roles.role_table(
        _events_text(spark, sf), threshold=1.0, inclusive=True,
        sample_values=100, order_by=F.col("event_id").cast("long"),
    )


@query("classify_first_rows", _prefix_classify_sql(None, 1000))
def classify_first_rows(spark, sf):
    """Unanimous typing over the first 1000 rows (T2's row sample)."""
    return roles.role_table(
        _events_text(spark, sf), threshold=1.0, inclusive=True,
        sample_rows=1000, order_by=F.col("event_id").cast("long"),
    )


# ------------------------------------------- text tables (posts stand-ins)


@query("documents_text_profile", _categorical_sql("documents", ["text", "lang", "source"]))
def documents_text_profile(spark, sf):
    """Distinct count and most frequent value over whole document texts."""
    return profile.categorical_profile(_t(spark, sf, "documents"), ["text", "lang", "source"], long_text=["text"])


@query(
    "documents_length_profile",
    _numeric_profile_sql("documents", ["n_chars"], "stddev_samp", quartiles=True),
)
def documents_length_profile(spark, sf):
    out = profile.numeric_profile(
        _t(spark, sf, "documents"), ["n_chars"], quantile_probs=(0.25, 0.5, 0.75), exact_scale=SCALE
    )
    return rnd(out, {"std": 4, "q25": 4, "q50": 4, "q75": 4})


@query(
    "documents_engagement_by_lang",
    f"""WITH g AS (SELECT lang, count(*) AS posts, {xsum('CAST(coalesce(n_chars, 0) AS DOUBLE)')} AS total_engagement,
    {xmean('CAST(coalesce(n_chars, 0) AS DOUBLE)')} AS avg_engagement FROM documents GROUP BY lang),
top AS (SELECT * FROM g ORDER BY total_engagement DESC, lang ASC NULLS FIRST LIMIT 10)
SELECT {rank_sql('total_engagement DESC, lang ASC NULLS FIRST')} AS rank, lang, posts, total_engagement, avg_engagement
FROM top""",
)
def documents_engagement_by_lang(spark, sf):
    return engagement.engagement_by_group(_t(spark, sf, "documents"), "lang", ["n_chars"], k=10, exact_scale=SCALE)


@query("documents_top_sources", _top_groups_sql("documents", ["lang", "source"], 10))
def documents_top_sources(spark, sf):
    return groups.top_groups(_t(spark, sf, "documents"), ["lang", "source"], k=10)


@query(
    "documents_exact_copies",
    """SELECT CAST(count(*) AS BIGINT) AS rows_before,
  (SELECT count(DISTINCT text) + max(CASE WHEN text IS NULL THEN 1 ELSE 0 END) FROM documents) AS rows_after,
  count(*) - (SELECT count(DISTINCT text) + max(CASE WHEN text IS NULL THEN 1 ELSE 0 END) FROM documents) AS duplicates_removed
FROM documents""",
)
def documents_exact_copies(spark, sf):
    """Exact copies of whole texts (U1/U3 on the text column)."""
    return clean.dedup_counts(_t(spark, sf, "documents").select("text"))


@query("conversations_role_share", _share_sql("conversations", "role"))
def conversations_role_share(spark, sf):
    return engagement.category_share(_t(spark, sf, "conversations"), "role")


@query(
    "conversations_first_turns",
    f"""WITH g AS (SELECT conv_id, min(turn) AS first_seen, count(*) AS row_count,
    {xmean('CAST(length(text) AS DOUBLE)')} AS m, count(text) AS text_chars_count
  FROM conversations GROUP BY conv_id ORDER BY first_seen ASC, conv_id ASC NULLS FIRST LIMIT 10)
SELECT {rank_sql('first_seen ASC, conv_id ASC NULLS FIRST')} AS rank, conv_id, first_seen, row_count,
  m AS text_chars_mean, text_chars_count FROM g""",
)
def conversations_first_turns(spark, sf):
    c = _t(spark, sf, "conversations").withColumn("text_chars", F.length("text"))
    return groups.first_groups(c, ["conv_id"], "turn", k=10, cols=["text_chars"], exact_scale=SCALE)


@query("labels_profile", _numeric_profile_sql("labels", ["quality", "toxic"], "stddev_pop"))
def labels_profile(spark, sf):
    out = profile.numeric_profile(_t(spark, sf, "labels"), ["quality", "toxic"], ddof=0, exact_scale=SCALE)
    return rnd(out, {"std": 4})


@query(
    "pages_trimmed_urls",
    "SELECT page_id, trim(url) AS url, length(html) AS html_chars FROM pages",
)
def pages_trimmed_urls(spark, sf):
    """P1 trim over text columns; the whole html is measured, not cut."""
    p = _t(spark, sf, "pages").select("page_id", "url", "html")
    return clean.trim_cells(p, ["url"]).select("page_id", "url", F.length("html").cast("long").alias("html_chars"))


# -------------------------------------------------------------- streaming


def _arriving(spark: SparkSession, sf: str, name: str, rows_per_file: int = 1_000_000) -> tuple[str, object]:
    """Land a driver table as Parquet files in the shared folder, the way a
    feed would drop them (as it is partitioned, without a shuffle), and return
    (folder, schema)."""
    d = _t(spark, sf, name)
    folder = shared_dir(spark, f"arriving-{name}")
    d.write.option("maxRecordsPerFile", rows_per_file).parquet(folder)
    return folder, d.schema


@query("stream_event_type_sizes", "SELECT event_type, count(*) AS size FROM events GROUP BY event_type")
def stream_event_type_sizes(spark, sf):
    """G1 as a running aggregate over arriving files, some files per micro-batch."""
    folder, schema = _arriving(spark, sf, "events")
    stream = read_stream(spark, folder, schema, max_files_per_trigger=64)
    return run_available(stream_group_sizes(stream, ["event_type"]), "event-type-sizes")


@query(
    "stream_user_engagement",
    f"""SELECT user_id, count(*) AS posts, {xsum('coalesce(value, 0)')} AS value,
  {xsum('coalesce(value, 0)')} AS total_engagement FROM events GROUP BY user_id""",
)
def stream_user_engagement(spark, sf):
    """G9 running totals per user over arriving files."""
    folder, schema = _arriving(spark, sf, "events")
    stream = read_stream(spark, folder, schema, max_files_per_trigger=64)
    return run_available(stream_engagement(stream, "user_id", ["value"], exact_scale=SCALE), "user-engagement")


# ------------------------------------------------ end-to-end analyses (§3)

LI_COLS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]


def _posts(spark, sf):
    from tablelens.plans.reports import posts_report

    return posts_report(
        _t(spark, sf, "lineitem"), page_key="l_suppkey", post_key="l_orderkey", category_key="l_returnflag",
        metrics=LI_METRICS, ranking_metrics=[*LI_METRICS, "l_discount"], order_by="l_orderkey", exact_scale=SCALE,
    )


def _ads(spark, sf):
    from tablelens.plans.reports import ads_report

    return ads_report(
        _t(spark, sf, "lineitem"), key_sets=[["l_suppkey"], ["l_suppkey", "l_partkey"]], json_columns=[],
        id_columns=["l_orderkey", "l_partkey", "l_suppkey"], exact_scale=SCALE,
    )


@query("first_rows_sample", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 100")
def first_rows_sample(spark, sf):
    """The first rows by an explicit order (the sample is the feature)."""
    return groups.first_rows(_t(spark, sf, "orders"), "o_orderkey", 100)


@query("posts_analysis_overview", _overview_sql("lineitem", LI_COLS, 6, 5))
def posts_analysis_overview(spark, sf):
    """Posts analysis on lineitem: ids stay text, so 6 numeric and 5 text columns."""
    return _posts(spark, sf)["overview"]


@query("posts_analysis_page_engagement", _page_sql("lineitem", "l_suppkey", LI_METRICS, 10))
def posts_analysis_page_engagement(spark, sf):
    return _posts(spark, sf)["page_engagement"]


@query(
    "ads_analysis_overview",
    _overview_sql("lineitem", LI_COLS, 5, 6).replace(
        " FROM lineitem",
        ", CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem) x) AS BIGINT) AS duplicates_removed"
        " FROM lineitem",
    ),
)
def ads_analysis_overview(spark, sf):
    """Ads analysis: strict nulls, unanimous typing, dedup counted while staging."""
    return _ads(spark, sf)["overview"]


@query("ads_analysis_candidate_top", _top_groups_sql("lineitem", ["l_linestatus"], 10))
def ads_analysis_candidate_top(spark, sf):
    """The grouping candidate chosen end to end (l_linestatus: 2 values), then its top groups."""
    return _ads(spark, sf)["candidate_l_linestatus_top"]


@query(
    "tweets_analysis_engagement",
    f"""WITH g AS (SELECT event_type, count(*) AS posts, {xsum('coalesce(value, 0)')} AS total_engagement,
    {xmean('coalesce(value, 0)')} AS avg_engagement FROM events GROUP BY event_type),
top AS (SELECT * FROM g ORDER BY total_engagement DESC, event_type ASC NULLS FIRST LIMIT 10)
SELECT {rank_sql('total_engagement DESC, event_type ASC NULLS FIRST')} AS rank, event_type, posts,
  total_engagement, avg_engagement FROM top""",
)
def tweets_analysis_engagement(spark, sf):
    from tablelens.plans.reports import tweets_report

    rep = tweets_report(
        _t(spark, sf, "events"), key_sets=[["event_type"]], metrics=["value"], engagement_keys=["event_type"],
        id_columns=["event_id", "user_id"], exact_scale=SCALE,
    )
    return rep["engagement_event_type"]


# The queries over text files register themselves here, too.
from tablelens.plans import catalogue_text  # noqa: E402,F401
