"""Every registered query against its DuckDB oracle on the smallest tables."""

import os

import pytest

import __spark_entry__ as E
from oracle_compare import compare, duck

SF = os.environ.get("FLOWMATCH_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")
NAMES = sorted(E.queries())


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    fn = E.queries()[name]
    sql = E.oracle_sql().get(name)
    if sql is None:
        assert fn(spark, SF).count() >= 0
        return
    problems, ns, nd = compare(spark, con, fn, sql, SF)
    assert not problems, problems


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert "overall" in df.columns and df.count() > 0
