"""Every registered query that SQL can express, against DuckDB on the smallest tables."""

import duckdb
import pytest

from kinfold.plans import fits  # noqa: F401
from kinfold.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(str(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_matches_sql(spark, con, name):
    got = plans.QUERIES[name](spark, SF).toPandas()
    want = con.sql(plans.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
