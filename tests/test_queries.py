"""Every registered query against its SQL, on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from scorelake.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def cell(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and np.isnan(v)):
        return ""
    return repr(float(v)) if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)) else str(v)


def shape(df):
    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert shape(got) == shape(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_model_columns_take_every_row(spark, con):
    total, quantity = con.execute("select count(*), sum(l_quantity) from lineitem").fetchone()
    assert sum(r["n"] for r in QUERIES["accuracy_by_label_lines"](spark, DATA).collect()) == total
    assert sum(float(x) for r in QUERIES["text_table_lines"](spark, DATA).collect() for x in r["line"].split(",")[1:] if x) == quantity
