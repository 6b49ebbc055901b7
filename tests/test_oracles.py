"""Every registered query with an oracle equals its DuckDB statement (sf0.001)."""

import os

import pytest

import __spark_entry__ as E
from clientlens.plans.compare import compare, duck
from tests.conftest import SF_SMALL

SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF_SMALL):
        pytest.skip("driver tables not available")
    return duck(SF_SMALL)


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    ok, msg = compare(E.queries()[name](spark, SF_SMALL), con, SQL[name])
    assert ok, msg


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns[:3] == ["client_id", "plan", "ville"]
    assert df.count() > 0
