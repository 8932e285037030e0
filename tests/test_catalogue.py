import glob
import os

import duckdb
import pandas as pd
import pytest

from tidemark.plans import catalogue

SMALL = "/root/testdata/sf0.001"
#: Compared with brute force in the tests of their operators.
WITHOUT_SQL = {"handoffs_orders", "alias_pairs_part", "odd_groups_lines"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("float"):
            df[c] = df[c].round(6)
        df[c] = df[c].map(lambda v: "~" if v is None or v is pd.NaT or v != v else str(int(v)) if isinstance(v, float) and v == int(v) else str(v))
    return sorted(map(tuple, df.values.tolist())), list(df.columns)


def test_each_query_has_sql():
    assert set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL) == WITHOUT_SQL


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_query_finds_what_is_planted(spark, name):
    assert 0 < catalogue.QUERIES[name](spark, SMALL).count() < 1000


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    assert plain(catalogue.QUERIES[name](spark, SMALL).toPandas()) == plain(duck.execute(catalogue.ORACLE_SQL[name]).df())
