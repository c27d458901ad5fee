"""Every driver query with SQL against DuckDB on the smallest tables."""
import os

import duckdb
import pytest

from helixspan.plans import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        path = f"{DATA}/{f}/*.parquet" if os.path.isdir(f"{DATA}/{f}") else f"{DATA}/{f}"
        c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{path}'")
    return c


def plain(rows):
    show = lambda x: str(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return sorted([tuple(map(show, r)) for r in rows])


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    df = queries.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    if name in queries.ORACLES:
        rel = con.sql(queries.ORACLES[name])
        assert sorted(rel.columns) == cols
        assert plain(got) == plain([tuple(r[rel.columns.index(c)] for c in cols) for r in rel.fetchall()])
    else:
        assert got
