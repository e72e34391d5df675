"""Queries with a statement give the same rows and types as DuckDB."""

import pytest
from compare import differences, oracle_connection

from gradebook.llm.oracle import ORACLE
from gradebook.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_oracle(spark, name):
    connection, result = oracle_connection(SF), QUERIES[name](spark, SF)
    relation = connection.sql(ORACLE[name])
    assert {c: TYPES[t] for c, t in result.dtypes} == dict(zip(relation.columns, map(str, relation.types)))
    assert differences(result, connection, ORACLE[name]) is None
