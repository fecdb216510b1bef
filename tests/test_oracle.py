"""Every named query with a SQL twin, at a small scale."""

import pytest

from shardloom.plans.catalog import QUERIES
from tests.compare import connect, difference


@pytest.fixture(scope="module")
def db(sf_dir):
    return connect(sf_dir)


def no_cross_join(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_equals_sql(spark, sf_dir, db, name):
    q = QUERIES[name]
    df = q.run(spark, sf_dir)
    assert no_cross_join(df)
    assert difference(df, q.sql, db) is None


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if not q.sql])
def test_has_rows(spark, sf_dir, name):
    df = QUERIES[name].run(spark, sf_dir)
    assert no_cross_join(df)
    assert df.count() > 0
