"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from gristmill.plans import texts


def normal(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if pd.isna(v):
            return ""
        return repr(float(v)) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)

    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].astype(object).to_numpy().tolist())


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(texts.ORACLE))
def test_query_matches_sql(name, spark, sf, duck):
    got, want = texts.QUERIES[name](spark, sf).toPandas(), duck.execute(texts.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


@pytest.mark.parametrize("name", sorted(set(texts.QUERIES) - set(texts.ORACLE)))
def test_query_without_sql_runs(name, spark, sf):
    assert texts.QUERIES[name](spark, sf).count() > 0


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
