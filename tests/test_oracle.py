"""Every registered query of the engine against its SQL in DuckDB."""

import os

import duckdb
import pytest

from pathloom.plans.oracle import ORACLE_SQL
from pathloom.plans.queries import QUERIES

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duckdb.connect()
    for name in sorted(os.listdir(sf_dir)):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def _key(row):
    return tuple((v is not None, isinstance(v, bool), repr(v)) for v in row)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, sf_dir, tables, name):
    found = QUERIES[name](spark, sf_dir)
    columns = sorted(found.columns)
    expected = tables.sql(ORACLE_SQL[name])
    assert sorted(expected.columns) == columns
    kinds = dict(zip(expected.columns, map(str, expected.types), strict=True))
    assert {c: TYPES[t] for c, t in found.dtypes} == kinds
    order = [expected.columns.index(c) for c in columns]
    theirs = sorted((tuple(r[k] for k in order) for r in expected.fetchall()), key=_key)
    ours = sorted((tuple(r[c] for c in columns) for r in found.collect()), key=_key)
    assert ours == theirs


def test_every_oracle_has_its_query():
    assert set(ORACLE_SQL) <= set(QUERIES)
