"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from oracle import compare, connect
from tessera import catalog

SF = "/root/testdata/sf0.001"
# The optional part brings its own tests.
OWN = set(catalog.QUERIES)
MODELS = {n for n in OWN if n not in catalog.ORACLES}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, con, name):
    assert compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) is None


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(MODELS))
def test_has_rows(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0
