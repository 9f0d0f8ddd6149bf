"""Every query with a DuckDB twin gives the twin's rows at sf0.001."""

import glob
import os

import duckdb
import pytest

from arcweave.plans import registry

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return repr(v + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_parity(spark, duck, name):
    df = registry.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    out = duck.execute(registry.oracles()[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == cols
    want = sorted(tuple(plain(dict(zip(names, r))[c]) for c in cols) for r in out.fetchall())
    assert got == want


def test_ids_are_of_the_inventory():
    ids = [i for v in registry.operators().values() for i in v.split()]
    assert all(i.partition("-")[2].isdigit() for i in ids)
    assert len(set(ids)) > 300
