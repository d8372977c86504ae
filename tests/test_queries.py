"""Every registered query of the library against its SQL, over the smallest tables."""

import os

import duckdb
import pytest

from chatlake import registry
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def plain(v):
    return f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    rel = con.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in rel.description]
    assert sorted(columns) == names
    place = [columns.index(c) for c in names]
    assert got == sorted(tuple(plain(r[i]) for i in place) for r in rel.fetchall())
