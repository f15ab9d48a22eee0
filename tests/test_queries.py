"""Every query with SQL gives what DuckDB gives; the others give rows."""

import duckdb
import pytest

from tests.conftest import DATA
from waymark import catalog

catalog.load()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA).toPandas()
    if name not in catalog.ORACLES:
        assert len(got)
        return
    want = duck.execute(catalog.ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    a, b = (d[cols].sort_values(cols).reset_index(drop=True) for d in (got, want))
    assert len(a) == len(b)
    for c in cols:
        assert [None if x != x or x is None else x for x in a[c].tolist()] == [None if x is None or x is not x and x != x else x for x in b[c].astype(object).where(b[c].notna(), None).tolist()], c
