"""Every registered query against DuckDB, and a look at its plan."""

import pytest

from __spark_entry__ import entry, queries
from tests.compare import compare, connect
from tracemill.plans import REGISTRY


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


# Queries without SQL text, each with another test of its own.
ROWS_ONLY = {"search_stemmed"}


def test_only_these_have_no_sql():
    assert {name for name, q in REGISTRY.items() if q.sql is None} == ROWS_ONLY
    assert set(REGISTRY) <= set(queries())


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query(spark, con, sf_dir, name):
    df = queries()[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    difference, _, _ = compare(spark, con, name, sf_dir, df)
    assert difference is None, difference


def test_entry(spark):
    assert entry(spark).count() > 0
