"""Every query that has SQL gives what DuckDB gives on the same tables."""

import duckdb
import pytest

from lumetric.plans.oracle import oracle_sql
from lumetric.plans.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(str(v) for v in row) for row in df.itertuples(index=False))


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_as_sql(spark, sf, con, name):
    got, want = QUERIES[name](spark, sf).toArrow().to_pandas(), con.sql(oracle_sql()[name]).to_arrow_table().to_pandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
