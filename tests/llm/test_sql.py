"""What SQL can express of the operators' results gives the rows that DuckDB does."""

import duckdb
import pytest

from pulsegrid.llm import oracles, registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for name in ("documents", "embeddings", "pages", "benchmark"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return c


def plain(x):
    return round(x, 4) + 0.0 if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_query(spark, db, name):
    df = registry.queries()[name](spark, DATA)
    cursor = db.execute(oracles.SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()), key=repr) == want and want
