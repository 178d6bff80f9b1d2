"""Queries against their DuckDB equivalents, on the driver's tables at sf0.001."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from lectern.plans import queries as base

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def value(v):
        if v is None or isinstance(v, float) and v != v or v is pd.NA:
            return ""
        return round(float(v), 5) if isinstance(v, float) or hasattr(v, "dtype") and v.dtype.kind == "f" else str(v)

    return sorted((tuple(str(value(v)).removesuffix(".0") for v in r) for r in df[sorted(df.columns)].itertuples(index=False)))


@pytest.mark.parametrize("name", sorted(base.ORACLES))
def test_query_equals_oracle(spark, duck, name):
    got, want = base.QUERIES[name](spark, SF).toPandas(), duck.sql(base.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(base.QUERIES) - set(base.ORACLES)))
def test_query_without_oracle_gives_rows(spark, name):
    assert base.QUERIES[name](spark, SF).count() > 0


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(base.QUERIES) <= set(entry.queries())
