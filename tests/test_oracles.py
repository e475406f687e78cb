"""Every query with SQL gives the same rows as the SQL does in DuckDB."""

import pytest

from oracle import connect, differences
from sluice import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, con, name):
    assert differences(spark, SF, name, catalog.queries()[name], catalog.oracle_sql()[name], con) is None


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0
