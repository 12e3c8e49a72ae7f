"""Queries of the corpus operators against their SQL, in columns, types and values."""

from pathlib import Path

import duckdb
import pytest

from costlens.llm.queries import ORACLE_SQL, QUERIES
from tests.test_parity import duck_type, sortable


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    want = duck.sql(ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    kinds = dict(zip(want.columns, map(str, want.types), strict=True))
    assert {c: duck_type(k) for c, k in got.dtypes} == {c: kinds[c] for c in got.columns}
    rows = [tuple(r) for r in got.select(*columns).collect()]
    quoted = ", ".join(f'"{c}"' for c in columns)
    expected = duck.sql(f"SELECT {quoted} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted(rows, key=sortable) == sorted(expected, key=sortable)
