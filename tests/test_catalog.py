"""Every registered query against its SQL in DuckDB, by values."""

import duckdb
import pandas as pd
import pytest

from docloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or pd.isna(v):
        return None
    return v.item() if hasattr(v, "item") else v


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, con, name):
    got = catalog.QUERIES[name](spark, SF)
    rows = [tuple(plain(r[c]) for c in sorted(got.columns)) for r in got.collect()]
    if name not in catalog.SQL:
        assert rows
        return
    cur = con.execute(catalog.SQL[name])
    names = [d[0] for d in cur.description]
    want = [tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall()]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(repr, rows)) == sorted(map(repr, want))
