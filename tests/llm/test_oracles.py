"""Queries that SQL can express, against their SQL."""

import pytest

from narrata.llm import queries
from tests.compare import of_duckdb, of_spark


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, sf, name):
    assert of_spark(queries.QUERIES[name](spark, sf)) == of_duckdb(queries.ORACLES[name], sf)
