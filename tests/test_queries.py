"""Every query against its SQL, and the others for rows and a stable schema."""

import pytest

from trailmark.plans.queries import ORACLE_SQL, QUERIES

from .helpers import assert_same, duck


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(name, spark, sf_dir, con):
    assert_same(QUERIES[name](spark, sf_dir), ORACLE_SQL[name], con)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_runs(name, spark, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    assert df.columns
    df.count()
