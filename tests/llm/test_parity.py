import glob
import os

import duckdb
import pytest

from arcweave.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_parity(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = queries.QUERIES[name](spark, SF)
    out = con.execute(queries.ORACLES[name])
    cols = sorted(d[0] for d in out.description)
    assert sorted(df.columns) == cols
    names = [d[0] for d in out.description]
    want = sorted(tuple(str(dict(zip(names, r))[c]) for c in cols) for r in out.fetchall())
    assert sorted(tuple(str(r[c]) for c in cols) for r in df.collect()) == want
