"""The queries against their SQL twins."""

import pytest
from compare import connect, differ

from tidemark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, sf, name):
    assert differ(spark, connect(sf), queries.queries()[name], queries.oracle_sql()[name], sf) is None
