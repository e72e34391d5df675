"""Every query with a statement gives the same rows and types as DuckDB."""

import pytest
from compare import differences, oracle_connection

from catalog.oracle import ORACLE
from catalog.queries import QUERIES

SF = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
         "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def connection():
    return oracle_connection(SF)


def test_every_query_has_a_statement():
    assert QUERIES.keys() == ORACLE.keys()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_oracle(spark, connection, name):
    result = QUERIES[name](spark, SF)
    relation = connection.sql(ORACLE[name])
    assert {c: TYPES[t] for c, t in result.dtypes} == dict(zip(relation.columns, map(str, relation.types)))
    assert differences(result, connection, ORACLE[name]) is None
