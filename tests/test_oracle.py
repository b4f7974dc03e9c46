"""Every query with SQL gives the rows that DuckDB does."""

import datetime
from pathlib import Path

import duckdb
import pytest

from pulsegrid.plans import catalog

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no tables here")


def plain(x):
    if isinstance(x, float):
        return None if x != x else round(x, 5) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    return x


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    df = catalog.QUERIES[name](spark, DATA)
    got = [r.asDict() for r in df.collect()]
    assert got
    if name not in catalog.SQL:
        return
    cursor = db.execute(catalog.SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in cursor.fetchall()), key=repr)
    have = sorted((tuple(plain(r[c]) for c in sorted(names)) for r in got), key=repr)
    assert len(want) == len(have)
    assert have == want
