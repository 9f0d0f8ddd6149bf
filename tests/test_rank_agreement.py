"""Ranks of all pairs from cells, against sorting them and against SQL."""

import os

import duckdb
import numpy as np
import pytest

from arcweave.operators import pairs, rank_agreement as R
from arcweave.plans import registry
from arcweave.sources.workspace import shared_folder

WIDTH = (3, 7)


def vectors(n=130, seed=1, grid=None):
    """Some alike, some without length, some null; on a ``grid``, most angles are shared by many pairs."""
    rng = np.random.default_rng(seed)
    v = [rng.normal(size=(n, w)) for w in WIDTH]
    if grid:
        v = [rng.integers(-grid, grid + 1, size=(n, w)).astype(float) for w in WIDTH]
    for m in v:
        m[11:15] = m[4]
        m[[20, 21]] = 0.0
        m[30] = np.nan
    null = np.zeros((2, n), bool)
    null[0, [3, 20, 40]] = null[1, [3, 50]] = True
    return v, null


def table(spark, ids, v, null):
    rows = [(int(i), v[0][k].tolist(), bool(null[0, k]), v[1][k].tolist(), bool(null[1, k])) for k, i in enumerate(ids)]
    return spark.createDataFrame(rows, "id long, a array<double>, no_a boolean, b array<double>, no_b boolean").repartition(3)


def by_sorting(ids, v, null):
    o = np.argsort(ids)
    i, j = (o[k] for k in np.triu_indices(len(ids), 1))
    ranks = []
    for m, no in zip(v, null):
        t = np.round(pairs.row_angles(m[i], m[j], 0.0), 9)
        t = np.where(np.isnan(t), 0.0, t)
        size = np.linalg.norm(m, axis=1)
        short = ~no & (size < 1e-10)
        t = np.where(short[i] | short[j], 0.0, np.where(no[i] | no[j], np.inf, t))
        r = np.empty(len(t))
        r[np.lexsort((ids[j], ids[i], t))] = np.arange(len(t))
        ranks.append(r)
    return float(np.corrcoef(*ranks)[0, 1])


@pytest.mark.parametrize("grid", [None, 1])
def test_all_ranks_are_found(spark, monkeypatch, grid):
    monkeypatch.setattr(R, "FINER", 4096)
    v, null = vectors(grid=grid)
    ids = np.random.default_rng(2).permutation(130) * 7 - 300
    n, rho, bound = R.rank_agreement(table(spark, ids, v, null))
    assert n == 130 * 129 // 2 and bound == 0
    assert rho == pytest.approx(by_sorting(ids, v, null), abs=1e-12)


def test_above_the_exact_size_only_large_cells_are_split(spark, monkeypatch):
    """Two or three angles for all pairs: split by ids until a cell holds one in 256, and within the bound of what is left open."""
    monkeypatch.setattr(R, "EXACT", 0)
    monkeypatch.setattr(R, "HEAVY", 8)
    v, null = vectors(grid=1)
    v[0][:, 1:] = 0.0
    ids = np.arange(130)
    n, rho, bound = R.rank_agreement(table(spark, ids, v, null))
    assert 0 < bound < 0.02 and abs(rho - by_sorting(ids, v, null)) < bound


def test_several_blocks_and_repeated_ids(spark, monkeypatch):
    v, null = vectors(n=130)
    ids = np.arange(130)
    one = R.rank_agreement(table(spark, ids, v, null))
    monkeypatch.setattr(R, "BLOCKS", 3)
    monkeypatch.setattr(R, "BLOCK_LEAST", 20)
    assert R.rank_agreement(table(spark, ids, v, null)) == pytest.approx(one, abs=1e-12)
    ids[129] = 0
    assert R.rank_agreement(table(spark, ids, v, null))[0] == 130 * 129 // 2 - 1


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few_rows(spark, n):
    v, null = vectors()
    got = R.rank_agreement(table(spark, np.arange(n), [m[:n] for m in v], null[:, :n]))
    assert got[0] == n // 2 and (got[1] is None if n < 2 else np.isnan(got[1]))


def stored(spark, folder, v, null):
    rows = [(k, None if null[:, k].all() else [None if null[int(m >= 3), k] else float(x) for m, x in enumerate(np.r_[v[0][k], np.zeros(4), v[1][k]])], k % 9) for k in range(len(v[0]))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def test_mantel_against_sql_with_nulls(spark, tmp_path):
    v, null = vectors()
    at = stored(spark, tmp_path, v, null)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{at}/embeddings.parquet/*.parquet'")
    want = con.execute(registry.oracles()["mantel"]).fetchall()
    assert [tuple(r) for r in registry.queries()["mantel"](spark, at).select("pairs", "rho").collect()] == want


def test_mantel_writes_no_pairs(spark, tmp_path):
    """700 vectors are 244,650 pairs, whose two angles alone are 3.9 MB."""

    def size():
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(shared_folder(spark).removeprefix("file:")) for f in fs)

    v, null = vectors(n=700)
    at, before = stored(spark, tmp_path, v, null), size()
    assert registry.queries()["mantel"](spark, at).first().pairs == 700 * 699 // 2
    assert size() - before < 2_000_000
