"""Proposed vectors of documents that share their head word."""

import os
import shutil

import duckdb
import numpy as np
import pytest

from arcweave.operators import curation
from arcweave.operators.curation import proposals
from arcweave.plans import registry
from arcweave.plans.dialect import DUCK, SPARK


def test_no_document_meets_all_that_mention_its_head(spark):
    """what mentions a head word is summed by word; a row for each document and mention grew with the square."""
    assert "o.doc_id <> h.k" not in proposals(SPARK) and "sums AS (SELECT head" in proposals(SPARK)


def test_views_are_of_the_folder_asked_for(spark, tmp_path):
    """What a view reads is bound to its own folder, whatever was read before."""
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=64)], i) for i in range(40)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    for t in ("documents", "benchmark"):
        (shutil.copytree if os.path.isdir(p := f"/root/testdata/sf0.001/{t}.parquet") else shutil.copy)(p, f"{tmp_path}/{t}.parquet")
    for name, key in (("trained_floor", "id"), ("midpoint_ranks", "c2")):
        registry.queries()[name](spark, "/root/testdata/sf0.001").collect()
        got = registry.queries()[name](spark, str(tmp_path)).collect()
        assert all(r[key] < 40 for r in got)


def test_words_do_not_travel(spark, tmp_path):
    """the program gives what the text says, without a shuffle of words; ids of documents and vectors may repeat."""
    con = duckdb.connect()
    rng = np.random.default_rng(5)
    for name in ("documents", "benchmark"):
        p = f"/root/testdata/sf0.001/{name}.parquet"
        con.execute(f"CREATE VIEW {name}_ AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    con.execute(f"COPY (SELECT * FROM documents_ UNION ALL SELECT * REPLACE (doc_id + 1 AS doc_id) FROM documents_ WHERE doc_id % 9 = 0 UNION ALL SELECT * REPLACE ('ox' AS text, 9999 AS doc_id) FROM documents_ WHERE doc_id = 3) TO '{tmp_path}/documents.parquet'")
    con.execute(f"COPY (SELECT * FROM benchmark_) TO '{tmp_path}/benchmark.parquet'")
    rows = [(i, [float(x) for x in rng.normal(size=64)], i) for i in [*range(0, 150), 7, 30]]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet{'' if os.path.isfile(f'{tmp_path}/{name}.parquet') else '/*.parquet'}'")
    want = {r[0]: r[1:] for r in con.execute(f"WITH {proposals(DUCK)} SELECT * FROM proposed WHERE id IS NOT NULL").fetchall()}
    plans = []
    kept, curation.keep = curation.keep, lambda df, name: plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or kept(df, name)
    try:
        got = {r[0]: tuple(r)[1:] for r in curation.proposed_kept(spark, str(tmp_path)).collect()}
    finally:
        curation.keep = kept
    assert set(got) == set(want) and len(want) > 150
    for k, v in want.items():
        assert got[k][0] == v[0] and got[k][1:] == pytest.approx(v[1:], abs=1e-9)
    assert not any("Generate explode" in p for _, p in plans)  # no row a word
