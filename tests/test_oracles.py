"""Every query with SQL, against DuckDB on the smallest tables."""

import pytest
from conftest import compare

from textloom.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, name):
    compare(spark, name, catalog.QUERIES[name], catalog.ORACLES[name])


def test_entry_has_all_queries(spark):
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries()) and set(catalog.ORACLES) <= set(entry.oracle_sql())
    assert entry.entry(spark).columns == ["target_word", "sim_word", "similarity", "rank"]
