"""The queries that SQL can express, against DuckDB; and the registration of all of them."""

import os

import duckdb
import pytest

from pathloom.llm.queries import ORACLE_SQL, QUERIES

TYPES = {"bigint": "BIGINT", "string": "VARCHAR"}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in sorted(os.listdir(sf_dir)):
        con.sql(f"CREATE VIEW {table.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{table}'")
    found, expected = QUERIES[name](spark, sf_dir), con.sql(ORACLE_SQL[name])
    columns = sorted(found.columns)
    assert sorted(expected.columns) == columns
    assert {c: TYPES[t] for c, t in found.dtypes} == dict(zip(expected.columns, map(str, expected.types), strict=True))
    order = [expected.columns.index(c) for c in columns]
    assert sorted(map(repr, ([r[c] for c in columns] for r in found.collect()))) == sorted(map(repr, ([r[k] for k in order] for r in expected.fetchall())))


def test_all_are_registered():
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries()) and sorted({int(n[2:].split("_")[0]) for n in QUERIES}) == list(range(1, 11))
    assert "pipeline" in __spark_entry__.queries() and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
