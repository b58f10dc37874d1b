import duckdb
import pytest

import __spark_entry__ as entry
from tablelens.llm.queries import LLM_QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_one_query_for_each_operator_and_the_pipeline():
    names = set(entry.queries())
    assert {n.split("_")[0] for n in LLM_QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert set(LLM_QUERIES) | {"pipeline"} <= names


@pytest.mark.parametrize("name", [n for n, (_, sql) in LLM_QUERIES.items() if sql])
def test_query_equals_its_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    want = con.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    got = [tuple(r[c] for c in order) for r in df.collect()]
    assert sorted(got, key=str) == sorted(want.select(*order).fetchall(), key=str)
    assert got
