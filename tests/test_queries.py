"""Every registered query on operation logs equals its SQL, row by row."""

import duckdb
import pytest

import __spark_entry__ as contract
from tideline import queries

TABLES = "region nation customer events documents pages conversations".split()


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, sf, db, name):
    rows = queries.QUERIES[name](spark, sf)
    found = db.execute(queries.ORACLE[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(rows.columns)
    ours = sorted(repr(tuple(plain(r[c]) for c in names)) for r in rows.collect())
    assert ours == sorted(repr(tuple(plain(v) for v in r)) for r in found.fetchall())


def test_contract(spark):
    assert contract.entry(spark).count() == 1000
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(queries.QUERIES) <= set(contract.queries())
