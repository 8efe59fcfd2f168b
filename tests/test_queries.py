"""Every query with SQL against DuckDB, on the smallest tables."""

import pytest

from interlace.plans.queries import ORACLES, QUERIES
from tests.conftest import compare


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(name, spark, sf):
    got, expected = compare(name, QUERIES, ORACLES, spark, sf)
    assert got == expected


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark, sf):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["row_id", "field_name", "pos", "item_value"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
