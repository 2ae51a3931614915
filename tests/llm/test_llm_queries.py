"""Every registered query of the subpackage with SQL gives what DuckDB gives on the same tables; the others give rows."""

from __future__ import annotations

import duckdb
import pytest

from parley.llm import queries as llm

SF = "/root/testdata/sf0.001"
QUERIES, SQL = llm.queries(), llm.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in ("documents", "benchmark", "labels"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def rows(table):
    names = sorted(table.column_names)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    return names, sorted((tuple(map(plain, row)) for row in zip(*[table.column(c).to_pylist() for c in names], strict=True)), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, SF).toArrow()) == rows(duck.execute(SQL[name]).to_arrow_table())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_a_row_for_each_document(spark, name):
    assert QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()
