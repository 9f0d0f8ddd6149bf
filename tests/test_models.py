"""Fitted models against direct solutions over the same rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from arcweave.functions import geometry as G
from arcweave.operators import models
from arcweave.plans import registry

SF = "/root/testdata/sf0.001"


def run(spark, name, at=SF):
    return registry.queries()[name](spark, at)


@pytest.fixture(scope="module")
def vectors(spark):
    t = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").toPandas()
    v = np.array(t.embedding.tolist(), float)
    return t.vec_id.to_numpy(), t.label.to_numpy() % 9, v[:, :14], v[:, 14:]


def test_linear_map(spark, vectors):
    _, _, y, x = vectors
    w = np.linalg.lstsq(x, y, rcond=None)[0]
    r2 = 1 - ((y - x @ w) ** 2).sum(axis=0) / ((y - y.mean(axis=0)) ** 2).sum(axis=0)
    assert [r.r2 for r in run(spark, "ols_projection_r2").collect()] == pytest.approx(r2, abs=1e-4)


def test_ridge_over_folds(spark, vectors):
    ids, _, y, x = vectors
    fold = ids * 5 // (ids.max() + 1)
    solve = lambda m, lam: np.linalg.solve(x[m].T @ x[m] + lam * np.eye(50), x[m].T @ y[m])
    want = {lam: 1 - sum(((y[fold == f] - x[fold == f] @ solve(fold != f, lam)) ** 2).sum() for f in range(5)) / (y**2).sum() for lam in (0.01, 0.1, 1.0, 10.0, 100.0)}
    got = run(spark, "ridge_cv").collect()
    assert {r.lam: r.r2 for r in got} == pytest.approx(want, abs=1e-4) and [r.lam for r in got if r.chosen] == [max(want, key=want.get)]
    err = sum(((y[fold == f] - x[fold == f] @ solve(fold != f, 1.0)) ** 2).sum(axis=0) for f in range(5))
    assert [r.r2 for r in run(spark, "axis_r2_cv").collect()] == pytest.approx(1 - err / ((y - y.mean(axis=0)) ** 2).sum(axis=0), abs=1e-4)


def test_leave_one_out_by_refitting(spark, vectors):
    ids, level, y, _ = vectors
    x, out = np.c_[np.ones(len(y)), y[:, :7]], y[:, 7:]
    reg = np.diag([0.0] + [0.1] * 7)
    got = {r.id: r for r in run(spark, "ridge_bridge_loo").collect()}
    assert len(got) == len(ids)
    for i in range(0, len(ids), 37):
        m = (level == level[i]) & (np.arange(len(ids)) != i)
        p = x[i] @ np.linalg.solve(x[m].T @ x[m] + reg, x[m].T @ out[m])
        assert got[ids[i]].loo_error == pytest.approx(np.linalg.norm(out[i] - p), abs=1e-4)
        cos = p @ out[i] / np.linalg.norm(p) / np.linalg.norm(out[i])
        assert got[ids[i]].own_angle == pytest.approx(math.degrees(math.acos(cos)), abs=1e-2)


def test_transfer_and_probe(spark, vectors):
    ids, _, y, x = vectors
    a, out = np.c_[np.ones(len(y)), y[:, :7]], y[:, 7:]
    reg = np.diag([0.0] + [0.1] * 7)
    got = {r.id: r for r in run(spark, "heldout_transfer").collect()}
    unit = out / np.linalg.norm(out, axis=1, keepdims=True)
    for i in range(0, len(ids), 41):
        m = ids % 5 != ids[i] % 5
        p = a[i] @ np.linalg.solve(a[m].T @ a[m] + reg, a[m].T @ out[m])
        order = np.argsort(-(unit @ p), kind="stable")
        assert got[ids[i]].nearest == ids[order[0]] and got[ids[i]].hit5 == (i in order[:5])
    rows = run(spark, "probe_calibration").collect()
    assert sum(r.n for r in rows) == len(ids)
    c = [r.calibrated for r in sorted(rows)]
    assert c == sorted(c)


def test_network_learns_what_a_line_cannot():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 3))
    y = np.c_[np.tanh(2 * x[:, 0]) * 1.5, np.abs(x[:, 1])]
    fit = np.arange(500) < 400
    net = models.mlp_train(lambda p: models.mlp_sums(p, x[:500], y[:500], fit), 3, 2, hidden=32, epochs=300, patience=20)
    err = lambda p: ((p - y[500:]) ** 2).mean()
    line = np.linalg.lstsq(np.c_[x[:400], np.ones(400)], y[:400], rcond=None)[0]
    assert err(np.tanh(x[500:] @ net[0] + net[1]) @ net[2] + net[3]) < 0.3 * err(np.c_[x[500:], np.ones(100)] @ line)


def test_network_over_partitions_is_the_network_in_one_place(spark):
    rng = np.random.default_rng(5)
    v, fit = rng.normal(size=(200, 7)), rng.random(200) < 0.7
    v[:, 5:] += np.tanh(v[:, :2])
    rows = spark.createDataFrame([(a.tolist(), bool(f)) for a, f in zip(v, fit)], "v array<double>, fit boolean").repartition(4)
    got = models.mlp_fit(rows, 5, hidden=9, epochs=12, patience=4)
    want = models.mlp_train(lambda p: models.mlp_sums(p, v[:, :5], v[:, 5:], fit), 5, 2, hidden=9, epochs=12, patience=4)
    assert all(np.abs(a - b).max() < 1e-6 for a, b in zip(got, want))
    # the gradient is that of the error
    p, flat = want, models.mlp_sums(want, v[:, :5], v[:, 5:], fit)
    loss = lambda q: ((np.tanh(v[fit, :5] @ q[0] + q[1]) @ q[2] + q[3] - v[fit, 5:]) ** 2).sum()
    up, down = [a.copy() for a in p], [a.copy() for a in p]
    up[0][2, 3] += 1e-5
    down[0][2, 3] -= 1e-5
    assert flat[2 * 9 + 3] == pytest.approx((loss(up) - loss(down)) / 2e-5, rel=1e-5)


def test_logistic_fits(spark):
    rng = np.random.default_rng(2)
    n = 3000
    a, b, fold = rng.normal(size=n), rng.normal(size=n), rng.integers(0, 5, n)
    y = rng.random(n) < 1 / (1 + np.exp(-(0.5 + 1.5 * a - 0.7 * b)))
    rows = spark.createDataFrame([("g", int(f), [1.0, float(p), float(q)], float(v)) for f, p, q, v in zip(fold, a, b, y)], "g string, fold int, x array<double>, y double")
    got = models.logistic_fits(rows)
    assert sorted(k[1] for k in got) == [-1, 0, 1, 2, 3, 4]
    for (_, out), (w, cov) in got.items():
        m = fold != out
        x = np.c_[np.ones(m.sum()), a[m], b[m]]
        p = 1 / (1 + np.exp(-x @ w))
        assert np.abs(x.T @ (y[m] - p) - 1e-3 * w).max() < 1e-5  # the gradient vanishes
        assert np.allclose(np.linalg.inv(cov), (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(3), rtol=1e-4)
    rows = run(spark, "logistic_oof_auroc").collect()
    assert all(r.auroc is None or 0 <= r.auroc <= 1 for r in rows) and any(r.auroc for r in rows)


def test_boundary_and_meta():
    x = np.arange(10.0)
    p = 1 / (1 + np.exp(-(x - 4.2) * 0.8))
    w, _ = models._irls_counts(np.c_[np.ones(10), x], np.full(10, 1e5), p * 1e5)
    assert -w[0] / w[1] == pytest.approx(4.2, abs=1e-3) and w[1] == pytest.approx(0.8, abs=1e-3)
    rng = np.random.default_rng(5)
    counts = np.zeros((2, 2, 4))
    for s in (0, 1):
        z = rng.normal(1.5 * (s - 0.5), 1, 60_000)
        for a, c in zip((z > 0.2).astype(int), np.minimum(3, np.abs(z - 0.2) / 0.5).astype(int)):
            counts[s, a, c] += 1
    d, c, meta = models.meta_fit(counts)
    assert d == pytest.approx(1.5, abs=0.03) and c == pytest.approx(0.2, abs=0.03) and meta == pytest.approx(1.5, abs=0.1)
    noisy = counts.copy()
    noisy[:, :, :] = counts.sum(axis=2, keepdims=True) / 4
    assert abs(models.meta_fit(noisy)[2]) < 0.2


def test_sharpening():
    p = np.array([0.5, 0.3, 0.15, 0.05])
    q = models.sharpened(p, 0.8)
    h = lambda a: -(a * np.log(a)).sum()
    assert h(q) == pytest.approx(0.8 * h(p), abs=1e-9) and q.sum() == pytest.approx(1) and (np.diff(q) < 0).all()


def test_psychometric_curve_beats_a_grid(spark):
    got = run(spark, "psychometric_fit").first()
    o = spark.read.parquet(f"{SF}/lineitem.parquet").groupBy(F.floor("l_quantity").alias("x")).agg(F.avg((F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(100)) < 100 - 50 * F.exp(-F.col("l_quantity") / 15)).cast("double")).alias("a"), F.count("*").alias("n")).orderBy("x").toPandas()
    x, k, n = o.x.to_numpy(float), (o.a * o.n).to_numpy(float), o.n.to_numpy(float)
    best = np.inf
    for guess in (0.0, 0.2, 0.4, 0.49):
        for lapse in (0.0, 0.05, 0.15):
            for mid in np.linspace(-20, 40, 25):
                for slope in (0.02, 0.05, 0.1, 0.2, 0.5):
                    c = np.clip(guess + (1 - guess - lapse) / (1 + np.exp(-np.clip((x - mid) * slope, -50, 50))), 1e-6, 1 - 1e-6)
                    best = min(best, -(k * np.log(c) + (n - k) * np.log(1 - c)).sum() / n.sum())
    assert got.loss < best + 0.01


def test_softmax_bar(spark):
    t = run(spark, "softmax_bar").collect()
    most = max(np.unique([r.trigram for r in t], return_counts=True)[1]) / len(t)
    assert np.mean([r.predicted == r.trigram for r in t]) > 1.5 * most and all(0 < r.confidence <= 1 for r in t)


def test_constrained_cores_meet_their_anchors(spark):
    c = {r.id: (r.x, r.y, r.z) for r in G.concepts(spark.read.parquet(f"{SF}/embeddings.parquet")).collect()}
    for r in run(spark, "constrained_cores").collect()[::25]:
        t = np.array([c[k] for k in ((r.id % 10) * 50 + i for i in range(3)) if k in c])
        t /= np.linalg.norm(t, axis=1, keepdims=True)
        v = np.array([r.x, r.y, r.z])
        assert np.linalg.norm(v) == pytest.approx(1, abs=1e-4) and r.loss == pytest.approx(((t @ v) ** 2).sum() + 0.001 * ((v - np.array(c[r.id])) ** 2).sum(), abs=1e-4)
        assert r.loss <= min(((t @ u) ** 2).sum() + 0.001 * ((u - np.array(c[r.id])) ** 2).sum() for u in np.eye(3))
