"""Every query of the core that SQL can express, against DuckDB on the same files."""

import glob
import os

import duckdb
import pytest

from patchwright.plans import catalog

SQL = catalog.oracle_sql()
QUERIES = catalog.queries()


def plain(x):
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, dict):
        return tuple((k, plain(v)) for k, v in sorted(x.items()))
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
        return round(float(x), 6) + 0.0
    return str(x)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    table = QUERIES[name](spark, sf).toArrow()
    assert table.column_names
    if name not in SQL:
        return
    cur = duck.execute(SQL[name])
    names = [d[0] for d in cur.description]
    want = [dict(zip(names, r)) for r in cur.fetchall()]
    assert sorted(names) == sorted(table.column_names)
    row = lambda r: repr(tuple(plain(r[c]) for c in sorted(names)))
    assert sorted(map(row, table.to_pylist())) == sorted(map(row, want))


def test_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)
