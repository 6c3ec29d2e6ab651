"""The registered queries against their DuckDB statements, and their registration."""

import duckdb
import pytest

import __spark_entry__ as registry
from boxoffice.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def test_registration():
    assert set(QUERIES) | {"pipeline"} <= set(registry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert ORACLE.items() <= registry.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_statement(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.execute(ORACLE[name])
    order = [c[0] for c in want.description]
    got = QUERIES[name](spark, SF)
    assert set(order) == set(got.columns)
    kinds = {c[0]: str(c[1]) for c in want.description}
    types = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    assert {n: types[t] for n, t in got.dtypes} == kinds
    assert sorted(repr(tuple(r)) for r in want.fetchall()) == sorted(repr(tuple(r[c] for c in order)) for r in got.collect())
