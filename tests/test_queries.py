"""Every registered query of the annotation operators against its SQL twin on the smallest tables."""

import math
import os

import pytest

from tessella.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "null" if math.isnan(v) else f"{v:.6f}"
    return "null" if v is None else str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows
    if name in registry.ORACLES:
        r = duck.execute(registry.ORACLES[name])
        names = [d[0] for d in r.description]
        assert sorted(names) == sorted(df.columns)
        at = [names.index(c) for c in df.columns]
        assert sorted(tuple(map(plain, x)) for x in rows) == sorted(tuple(plain(x[i]) for i in at) for x in r.fetchall())
