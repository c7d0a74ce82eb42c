import pytest

from corpusloom.llm import oracles, queries


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_agrees_with_sql(name, agrees):
    agrees(queries.QUERIES[name], oracles.ORACLES[name])
