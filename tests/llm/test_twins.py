"""The corpus queries that SQL can express against their DuckDB twins."""

import pytest
from compare import differences, duck

from siltstone.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_twin(spark, sf_dir, name):
    assert differences(spark, duck(sf_dir), queries.queries()[name], queries.oracle_sql()[name], sf_dir) == []
