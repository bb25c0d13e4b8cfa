"""Every registered time-series query against its SQL twin; those without one must have rows, but for tests that need more days than the table has."""

import pytest
from compare import connect, differ

import __spark_entry__ as entry

FEW_DAYS = {"superior_ability", "sharpe_difference"}
NAMES = [q for q in entry.queries() if not q.startswith("op") and q != "pipeline"]


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, con, name):
    said = differ(spark, con, entry.queries()[name], entry.oracle_sql().get(name), sf)
    assert said is None or (said == "no rows" and name in FEW_DAYS)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns and df.count() > 0


def test_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
