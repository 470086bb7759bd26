"""Every named query against its twin in SQL."""

import pytest
from compare import differences

from trellis.queries import catalogue, extras, store, terms

QUERIES = {k: f for m in (catalogue, store, extras, terms) for k, f in m.QUERIES.items()}
SQL = {k: s for m in (catalogue, store, extras, terms) for k, s in m.SQL.items()}


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    assert name in SQL
    assert differences(df, duck, SQL[name]) == ""
