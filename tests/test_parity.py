"""Every registered query against its SQL, row by row and type by type."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as driver

QUERIES = driver.billing_queries()
ORACLES = {k: v for k, v in driver.oracle_sql().items() if k in QUERIES}

# Spark type -> DuckDB type.
DUCK_TYPES = {
    "string": "VARCHAR",
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp": "TIMESTAMP",
}


def duck_type(spark_type: str) -> str:
    return DUCK_TYPES.get(spark_type, spark_type.upper())


def sortable(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def test_every_query_has_sql_or_a_reason():
    assert set(QUERIES) - set(ORACLES) == {"preview"}
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    want = duck.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    spark_types = dict(got.dtypes)
    duck_types = dict(zip(want.columns, map(str, want.types)))
    assert {c: duck_type(spark_types[c]).replace(" ", "") for c in columns} == {
        c: duck_types[c].replace(" ", "") for c in columns
    }
    quoted = ", ".join(f'"{c}"' for c in columns)
    got_rows = [tuple(r) for r in got.select(*columns).collect()]
    want_rows = duck.sql(f"SELECT {quoted} FROM ({ORACLES[name]})").fetchall()
    assert len(got_rows) == len(want_rows)
    assert sorted(got_rows, key=sortable) == sorted(want_rows, key=sortable)


def test_preview_is_ten_rows(spark, sf_dir):
    assert QUERIES["preview"](spark, sf_dir).count() == 10


def test_entry(spark):
    assert driver.entry(spark).count() == 10
