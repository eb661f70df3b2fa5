"""Every query runs and, where SQL can express it, equals DuckDB on the same tables."""

import glob
import os

import duckdb
import pytest

from leafmill.plans import registry


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    fix = lambda v: round(v, 4) if isinstance(v, float) else int(v) if isinstance(v, bool) else str(v) if v is not None and not isinstance(v, (int, str)) else v
    return sorted(([fix(r[k]) for k in order] for r in rows), key=repr)


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf, duck, name):
    df = registry.queries()[name](spark, sf)
    got = df.collect()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    cur = duck.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, got) == rows_of(names, want)
