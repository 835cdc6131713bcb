"""Every registered query against its SQL on the smallest tables."""

import os
from contextlib import contextmanager

import pytest

import __spark_entry__ as entry_module
from check import connect, differences

from voxelarium.storage import scratch, shared_root

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@contextmanager
def nothing_left(spark):
    """No folder and no persisted frame outlives a query whose result was read."""
    root, cached = shared_root(spark), spark.sparkContext._jsc.getPersistentRDDs
    before = set(os.listdir(root)), set(cached())
    with scratch(spark):
        yield
    assert (set(os.listdir(root)), set(cached())) == before


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    with nothing_left(spark):
        ours = QUERIES[name](spark, SF).toPandas()
    theirs = con.execute(ORACLES[name]).df()
    assert not differences(ours, theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    with nothing_left(spark):
        assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
