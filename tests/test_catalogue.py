"""Every registered query against its DuckDB oracle on the sf0.001 tables
(the driver runs the same comparison at sf0.01)."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tablelens.plans.catalogue import CATALOGUE
from tablelens.sources.tables import TABLES

SF = "/root/testdata/sf0.001"


def norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        if math.isnan(v):
            return None
        if math.isinf(v):
            return v
        if v == int(v) and abs(v) < 2**53:
            return int(v)
        return round(v, 6)
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime()
    return v


def canon(pdf):
    cols = sorted(pdf.columns)
    rows = [tuple(norm(x) for x in rec) for rec in pdf[cols].itertuples(index=False)]
    return cols, sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    assert set(CATALOGUE) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(CATALOGUE))
def test_query_matches_oracle(spark, con, name):
    got = canon(entry.queries()[name](spark, SF).toPandas())
    want = canon(con.sql(entry.oracle_sql()[name]).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["rank", "l_suppkey", "l_quantity", "l_extendedprice", "l_tax", "total_engagement"]
    assert df.count() == 10
