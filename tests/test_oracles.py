"""Every registered query against its DuckDB oracle on the smallest data set (the driver uses sf0.01)."""

from __future__ import annotations

import pytest

from tracefold.plans.catalog import all_queries
from tracefold.plans.verify import compare, duck_connect
from tracefold.sources.testdata import TABLES

QUERIES = all_queries()
WITH_SQL = sorted(n for n, q in QUERIES.items() if q.sql)
ROWS_ONLY = sorted(n for n, q in QUERIES.items() if not q.sql)


@pytest.fixture(scope="module")
def duck(sf001):
    return duck_connect(sf001, TABLES)


@pytest.mark.parametrize("name", WITH_SQL)
def test_query_matches_oracle(spark, sf001, duck, name):
    q = QUERIES[name]
    ok, msg = compare(q.fn(spark, sf001), duck, q.sql)
    assert ok, f"{name}: {msg}"


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_rows_only_query_runs(spark, sf001, name):
    df = QUERIES[name].fn(spark, sf001)
    assert df.count() > 0
    assert df.schema == QUERIES[name].fn(spark, sf001).schema


def test_entry_contract(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
