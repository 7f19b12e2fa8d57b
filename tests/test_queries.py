"""Every registered query against DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from tracelake.plans import registry

D = "/root/testdata/sf0.001"


def rows(df):
    df = df[sorted(df.columns)]
    text = lambda v: "null" if pd.isna(v) else f"{float(v):.6g}" if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)
    return sorted(tuple(text(v) for v in r) for r in df.astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in os.listdir(D):
        c.execute(f"create view {t.split('.')[0]} as select * from '{D}/{t}'")
    return c


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_query(spark, duck, name):
    ours, theirs = registry.queries()[name](spark, D).toPandas(), duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_rows(spark, name):
    df = registry.queries()[name](spark, D)
    rows = df.toPandas()
    assert len(rows)
    assert len(set(df.columns)) == len(df.columns)
