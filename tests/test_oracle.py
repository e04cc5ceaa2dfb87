"""Every query with SQL against DuckDB on the same tables; the others must return rows."""

import os

import duckdb
import pytest

from skyweft import plans

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return connection


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda x: repr(round(x, 5) + 0.0) if isinstance(x, float) else repr(x)
    return sorted(tuple(clean(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, duck, name):
    found = plans.queries()[name](spark, SF)
    rows = found.collect()
    assert rows
    if name in plans.oracle_sql():
        result = duck.execute(plans.oracle_sql()[name])
        columns = [c[0] for c in result.description]
        wanted = result.fetchall()
        assert sorted(columns) == sorted(found.columns)
        mine, theirs = _rows(found.columns, [tuple(r) for r in rows]), _rows(columns, wanted)
        assert len(mine) == len(theirs)
        different = [(a, b) for a, b in zip(mine, theirs, strict=True) if a != b]
        assert not different, different[:3]
