"""Every registered query against its SQL counterpart, at the smallest size."""

import pytest

import __spark_entry__ as checks
from workload.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def db(sf_dir):
    from compare import database

    return database(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(checks.queries())


def test_entry(spark):
    assert checks.entry(spark).columns[:2] == ["seq", "flight_number"]


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, db, sf_dir, name):
    from compare import difference

    ours = checks.queries()[name](spark, sf_dir).toPandas()
    problem = difference(ours, db.execute(checks.oracle_sql()[name]).df())
    assert problem is None or problem.startswith("ok"), problem
    assert len(ours) > 0
