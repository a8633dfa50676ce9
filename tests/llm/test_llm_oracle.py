"""The queries that SQL can express, against DuckDB."""

import pytest

from lectern.llm.queries import ORACLE_SQL, QUERIES
from oracle import connection, difference

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    assert difference(QUERIES[name](spark, SF), connection(SF), ORACLE_SQL[name]) is None


def test_names():
    assert set(ORACLE_SQL) <= set(QUERIES)
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
