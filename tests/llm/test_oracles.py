"""Queries of the corpus operators against their SQL, whole results on the small tables."""

import pytest

from lodestone.llm import queries
from tests import oracle

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def connection():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query(spark, connection, name):
    assert oracle.compare(spark, queries.QUERIES, queries.ORACLE_SQL, name, SF, connection) > 0
