"""Every query of the engine's own operators against its SQL."""

import pytest

from narrata import registry
from tests.compare import of_duckdb, of_spark


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)


#: Cases that only larger tables have.
LARGER = ("grounding_numbers", "unsupported_classes", "split_leaks")


@pytest.mark.parametrize("name", LARGER)
def test_query_of_more_rows(spark, name):
    test_query(spark, "/root/testdata/sf0.01", name)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, name):
    columns, rows = of_spark(registry.QUERIES[name](spark, sf))
    want_columns, want = of_duckdb(registry.ORACLES[name], sf)
    assert columns == want_columns
    assert len(rows) == len(want)
    for a, b in zip(rows, want, strict=True):
        assert a == b
