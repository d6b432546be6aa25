"""Every query of the catalogue against its SQL on the smallest tables."""

import pytest

from gridextract import catalog
from tests.conftest import SF


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(same, name):
    same(catalog.QUERIES[name], catalog.ORACLE_SQL[name])


def test_entry_imports_and_lists_queries(spark):
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries())
    assert entry.entry(spark).count() == 5
