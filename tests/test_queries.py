"""Every query with SQL gives the rows of its SQL; every query runs."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for f in os.listdir(D):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{D}/{f}'")
    return c


def canon(df: pd.DataFrame) -> list:
    def one(v):
        if isinstance(v, (list, np.ndarray)):
            return tuple(v)
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        v = v.item() if hasattr(v, "item") and getattr(v, "size", 1) == 1 else v
        return round(v, 6) + 0.0 if isinstance(v, float) else v

    return sorted((tuple(one(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    got = entry.queries()[name](spark, D)
    assert len(set(got.columns)) == len(got.columns)
    if name not in SQL:
        got.write.format("noop").mode("overwrite").save()
        return
    a, b = got.toPandas(), con.sql(SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert canon(a) == canon(b)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(entry.queries())
