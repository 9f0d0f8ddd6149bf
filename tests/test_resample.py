import duckdb
import numpy as np

from arcweave.operators import resample


def test_weights_are_poisson_and_the_same_in_sql():
    w = resample.weights(np.arange(3000), 300)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    share = [(w == k).mean() for k in range(4)]
    assert np.allclose(share, [0.3679, 0.3679, 0.1839, 0.0613], atol=0.004)
    # neither units nor replicates go together
    c = np.corrcoef(w[:200])
    assert np.abs(c - np.eye(200)).max() < 0.35 and abs((c - np.eye(200)).mean()) < 0.01
    c = np.corrcoef(w.T[:200])
    assert np.abs(c - np.eye(200)).max() < 0.12 and abs((c - np.eye(200)).mean()) < 0.01
    got = duckdb.connect().execute(f"SELECT u, b, {resample.weight_sql('u', 'b')} FROM range(40) a(u), range(1, 51) z(b) ORDER BY 1, 2").fetchnumpy()
    assert (np.array(list(got.values())[2]).reshape(40, 50) == resample.weights(np.arange(40), 50)).all()


def test_sums_and_their_spread(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i // 2), "ab"[i % 2] if i % 7 else None, float(x)) for i, x in enumerate(rng.normal(3, 2, 4000))] + [(None, "a", 1e9), (7, "a", None)]
    df = spark.createDataFrame(rows, "u long, g string, v double").repartition(5)
    got = resample.poisson_sums(df, "u", "g", ["v"], 400).collect()
    assert len(got) == 3 * 401
    by = {(r.g, r.b): r for r in got}
    w = np.concatenate([np.ones((2000, 1)), resample.weights(np.arange(2000), 400)], axis=1)
    for g in ("a", "b", None):
        own = [(u, v or 0.0) for u, h, v in rows if u is not None and h == g]
        for b in (0, 1, 17, 400):
            assert abs(by[g, b].v - sum(w[u, b] * v for u, v in own)) < 1e-6 and by[g, b].n == sum(w[u, b] for u, _ in own)
    means = np.array([by["b", b].v / by["b", b].n for b in range(1, 401)])
    assert 0.7 < means.std() / (2 / np.sqrt(by["b", 0].n)) < 1.3
    assert resample.poisson_sums(df.limit(0), "u", "g", ["v"], 5).count() == 0
