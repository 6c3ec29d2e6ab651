"""Every registered query against its DuckDB statement on the smallest given tables."""

import math

import duckdb
import pytest

import __spark_entry__ as registry
from boxoffice.plans.catalog import QUERIES
from boxoffice.plans.oracle import ORACLE
from tests.conftest import SF

NAMES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()
TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def test_every_query_has_a_statement():
    assert QUERIES.keys() == ORACLE.keys()
    assert QUERIES.items() <= registry.queries().items() and ORACLE.items() <= registry.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_statement(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.execute(ORACLE[name])
    kinds = {c[0]: str(c[1]) for c in want.description}
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema} == kinds
    order = [c[0] for c in want.description]
    expected = sorted(repr(tuple(_plain(v) for v in row)) for row in want.fetchall())
    assert sorted(repr(tuple(_plain(r[c]) for c in order)) for r in df.collect()) == expected


def test_entry(spark):
    assert registry.entry(spark).count() == 5
