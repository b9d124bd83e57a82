"""Every query with SQL gives the rows of that SQL on another engine."""

import os

import duckdb
import pytest

from marginalia.plans import answer_queries, catalogue_queries, check_queries, notebook_queries, records  # noqa: F401  (each registers its queries)
from marginalia.plans import queries as q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for f in os.listdir(SF):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


def rows(df):
    cols = sorted(df.columns)
    return sorted(tuple(f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in df[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_same_rows(spark, duck, name):
    mine, theirs = q.queries()[name](spark, SF).toPandas(), duck.sql(q.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)
