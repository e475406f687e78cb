"""Queries with SQL give the same rows as the SQL does in DuckDB."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from oracle import connect, differences  # noqa: E402

from sluice.llm import queries  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, name):
    sf = "/root/testdata/sf0.01"
    assert differences(spark, sf, name, queries.queries()[name], queries.oracle_sql()[name], connect(sf)) is None
