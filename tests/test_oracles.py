"""Every query with SQL, against DuckDB on the same tables."""

import os

import duckdb
import pandas as pd
import pytest

from tessera.plans.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "embeddings", "benchmark", "labels", "conversations", "pages"):
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    own = QUERIES[name](spark, SF).toPandas()
    other = duck.sql(ORACLES[name]).df()
    columns = sorted(own.columns)
    assert columns == sorted(other.columns)
    frames = [f[columns].sort_values(columns).reset_index(drop=True) for f in (own, other)]
    pd.testing.assert_frame_equal(*frames, check_dtype=False, rtol=0, atol=2e-6)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_reads_given_tables(spark, name):
    """No query gives rows without the tables."""
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        QUERIES[name](spark, "/nowhere").collect()
