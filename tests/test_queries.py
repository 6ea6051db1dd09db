"""Every registered query against its SQL on the smallest tables."""

import os

import pytest
from oracle import compare, connect

from galespark.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ORACLE = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", [q for q in registry.queries() if q in ORACLE])
def test_matches_sql(spark, con, name):
    rows, why = compare(registry.queries()[name](spark, SF), con, ORACLE[name])
    assert why is None, why


@pytest.mark.parametrize("name", [q for q in registry.queries() if q not in ORACLE])
def test_runs(spark, name):
    df = registry.queries()[name](spark, SF)
    assert df.columns and df.count() >= 0
