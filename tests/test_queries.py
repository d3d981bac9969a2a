"""Every core query with SQL gives the rows of its SQL on the small tables."""

import pytest

from memlake.plans import graph_queries, interval_queries, search_queries, source_queries, store_queries, text_queries
from tests.helpers import DATA, oracle, spark_rows

MODULES = [interval_queries, store_queries, graph_queries, search_queries, text_queries, source_queries]
QUERIES = {k: (f, m.SQL.get(k)) for m in MODULES for k, f in m.QUERIES.items()}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    query, sql = QUERIES[name]
    columns, rows = spark_rows(query(spark, DATA))
    assert columns
    if sql:
        assert (columns, rows) == oracle(sql)
