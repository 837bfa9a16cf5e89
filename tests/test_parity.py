"""Every query with SQL gives what DuckDB gives on the same tables."""

import datetime
import os

import numpy as np
import pandas as pd
import pytest

from caseflow.plans import parity

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, (float, np.floating)) and np.isnan(v)):
        return "-"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, float, np.integer, np.floating)):
        return f"{float(v):.9g}"
    if isinstance(v, (datetime.date, pd.Timestamp)):
        return pd.Timestamp(v).isoformat()
    return str(v)


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(plain(x) for x in row) for row in df[columns].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(parity.ORACLE))
def test_matches_sql(spark, duck, name):
    assert rows(parity.QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(parity.ORACLE[name]).df())


def test_queries_without_sql_have_a_test_of_their_own():
    with open(os.path.join(os.path.dirname(__file__), "test_guards_whole_tables.py"), encoding="utf-8") as f:
        told = f.read()
    assert [name for name in set(parity.QUERIES) - set(parity.ORACLE) if f'"{name}"' not in told] == []


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
