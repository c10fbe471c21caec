"""Every registered query with an oracle against DuckDB on the same tables."""

import math
import os
from glob import glob

import duckdb
import pytest

import __spark_entry__ as entry
from gridindex.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return repr(v)
    if isinstance(v, (int, float)):
        return "nan" if isinstance(v, float) and math.isnan(v) else f"{float(v):.5g}" if abs(v) > 1e9 else f"{round(float(v), 5) + 0.0:.5f}"
    return str(v)


#: kmeans_nearest runs the same clustering and checks it.
@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - {"kmeans_profiles"}))
def test_query(spark, duck, name):
    out = catalog.QUERIES[name](spark, SF)
    if name not in catalog.ORACLES:
        assert out.count() > 0
        return
    columns = sorted(out.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in out.collect())
    cursor = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in cursor.fetchall())
    assert len(got) == len(want)
    off = [(g, w) for g, w in zip(got, want) if g != w]
    assert not off, off[:3]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
