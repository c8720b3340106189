"""A fixed tree of sources through parsers, resolution, detectors, report and configuration."""

import duckdb
import pytest
import samples


@pytest.fixture(scope="module")
def duck():
    return duckdb.connect()


@pytest.mark.parametrize("name", samples.QUERIES)
def test_rows_by_hand(spark, duck, name):
    df, want = samples.QUERIES[name](spark, None), duck.sql(samples.ORACLE_SQL[name])
    cols = sorted(df.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())
