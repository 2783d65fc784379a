"""Every named query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry_module
from compare import connect, difference
from surveyloom.plans import queries as named

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


# fitted classifiers and their accuracies; tests/test_models.py checks them
NO_SQL = {
    "logistic", "forest", "mlp", "mlp_penalized", "knn_roles", "evaluate", "evaluate_grouped", "grid_search", "repeated_holdout",
}


def test_every_query_has_sql_but_for_those_named():
    assert set(SQL) <= set(QUERIES)
    assert set(named.ALL) - set(SQL) == NO_SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    assert difference(QUERIES[name](spark, SF), con, SQL[name]) is None


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
