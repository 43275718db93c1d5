"""Every query that has SQL gives what DuckDB gives on the smallest tables; those without are only run."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from quire import plans

DIR = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat().replace("+00:00", "")
    if type(v).__name__ == "Decimal":
        return round(float(v), 6)
    if hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, DIR)
    rows = df.collect()
    if name not in plans.SQL:
        return
    r = duck.execute(plans.SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    got = sorted(repr([plain(x[c]) for c in order]) for x in rows)
    want = sorted(repr([plain(x[names.index(c)]) for c in order]) for x in r.fetchall())
    assert got == want
