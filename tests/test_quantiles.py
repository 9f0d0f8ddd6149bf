import numpy as np
import pytest

from arcweave.operators import quantiles


@pytest.mark.parametrize("cells,most", [(1024, 4096), (5, 8)])
def test_against_sorting(spark, monkeypatch, cells, most):
    monkeypatch.setattr(quantiles, "CELLS", cells)
    monkeypatch.setattr(quantiles, "MOST", most)
    rng = np.random.default_rng(1)
    groups = {"wide": rng.normal(0, 1e6, 700), "ties": rng.integers(0, 4, 500).astype(float), "one": np.array([3.5]), "two": np.array([1.0, 2.0]), "same": np.full(90, -2.0), None: rng.random(50), "skew": np.r_[np.zeros(300), rng.exponential(1e-9, 200), [1e12]]}
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("none", None), ("wide", None), ("two", float("nan"))]
    shares = (0.0, 0.05, 0.5, 0.9, 1.0)
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    got = {(r.g, r.share): r.q for r in quantiles.quantiles(df, "g", "v", shares).collect()}
    want = {(g, s): float(np.quantile(v, s)) for g, v in groups.items() for s in shares}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-18) for k in want)


def test_no_rows(spark):
    assert quantiles.quantiles(spark.createDataFrame([], "g string, v double"), "g", "v", (0.5,)).collect() == []
