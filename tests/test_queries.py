import os

import duckdb
import pytest

import __spark_entry__
from meshframe.plans import catalog, levels, oracles, solving
from tests.conftest import SF


@pytest.fixture(scope="module")
def duck():
    made = duckdb.connect()
    for f in os.listdir(SF):
        made.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return made


def test_registered():
    assert set(oracles.ORACLES) <= set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


QUERIES, SQL = {**catalog.QUERIES, **levels.QUERIES, **solving.QUERIES}, {**oracles.ORACLES, **levels.ORACLES, **solving.ORACLES}


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = duck.sql(SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got) == len(want)
    sort = lambda d: d[columns].sort_values(columns).reset_index(drop=True)
    a, b = sort(got), sort(want)
    for c in columns:
        assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 200
