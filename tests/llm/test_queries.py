"""Every query with SQL against it, on the smallest tables."""

import pytest
from oracle import connect, same

from marlstone.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf, name):
    same(queries.QUERIES[name](spark, sf), connect(sf).sql(queries.ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_other_queries_run(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).columns
