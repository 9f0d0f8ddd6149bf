"""Fitted models: regressions from Gram sums, iterative fits and sampled nulls.

Sums over rows are taken by Spark, as partial Gram matrices of each partition;
what comes to the driver is a matrix of the feature count, or counts of a few
levels; no group of rows is taken into one task.
"""

from __future__ import annotations

import functools
import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..sources.workspace import keep
from . import ordered, rewiring, search


def unless_empty(table: str, schema: str):
    """A query that gives no rows, of ``schema``, where ``table`` has none: there is nothing to fit."""

    def wrap(f):
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            if not spark.read.parquet(f"{sf_dir}/{table}.parquet").limit(1).count():
                return spark.createDataFrame([], schema)
            return f(spark, sf_dir)

        return run

    return wrap


def gram(rows: DataFrame, folds: int) -> dict[int, np.ndarray]:
    """Sum of v v' by fold of (fold int, v array<double>); (width, width) each."""

    def part(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            fold = b.column(0).to_numpy()
            v = np.array(b.column(1).to_pylist(), float)
            for k in np.unique(fold):
                m = v[fold == k]
                total[int(k)] = total.get(int(k), 0) + m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([m.ravel().tolist() for m in total.values()], pa.list_(pa.float64()))], names=["fold", "g"])

    sums = rows.mapInArrow(part, "fold int, g array<double>").select("fold", F.posexplode("g").alias("pos", "x")).groupBy("fold", "pos").agg(F.sum("x").alias("x")).collect()
    out: dict[int, np.ndarray] = {}
    width = int(round(max((r.pos for r in sums), default=0) ** 0.5 + 0.5))
    for r in sums:
        out.setdefault(r.fold, np.zeros(width * width))[r.pos] = r.x
    return {k: v.reshape(width, width) for k, v in out.items()}


def _projection_rows(spark: SparkSession, sf_dir: str, folds: int) -> DataFrame:
    """(fold, [50 raw components, 14 concept components]) of every vector, folds contiguous by id."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    n = e.agg(F.max("vec_id")).first()[0] + 1
    v = F.concat(F.slice("embedding", 15, 50), F.slice("embedding", 1, 14)).cast("array<double>")
    return e.select(F.floor(F.col("vec_id") * folds / F.lit(n)).cast("int").alias("fold"), v.alias("v"))


def _solve(g: np.ndarray, k: int, lam: float = 0.0) -> np.ndarray:
    return np.linalg.solve(g[:k, :k] + lam * np.eye(k), g[:k, k:])


def _sse(g: np.ndarray, w: np.ndarray) -> np.ndarray:
    k = len(w)
    return np.diag(g[k:, k:]) - 2 * (w * g[:k, k:]).sum(axis=0) + np.einsum("ij,ik,kj->j", w, g[:k, :k], w)


@unless_empty("embeddings", "axis string, r2 double")
def ols_projection_r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2 of each of the 14 components from 50 raw ones, without intercept."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    g = gram(_projection_rows(spark, sf_dir, 1), 1)[0]
    means = e.select(*[F.sum(F.element_at("embedding", i + 1).cast("double")).alias(f"s{i}") for i in range(14)], F.count("*").alias("n")).first()
    w = _solve(g, 50)
    sst = np.diag(g[50:, 50:]) - np.array([means[f"s{i}"] ** 2 / means.n for i in range(14)])
    r2 = 1 - _sse(g, w) / sst
    return spark.createDataFrame([(k, round(float(x), 5)) for k, x in zip(G.ESSENCE + G.FUNCTION, r2)], "axis string, r2 double")


@unless_empty("embeddings", "lam double, r2 double, chosen boolean")
def ridge_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out error of each ridge strength over five contiguous folds; the best is marked."""
    grams = gram(_projection_rows(spark, sf_dir, 5), 5)
    total = sum(grams.values())
    rows = []
    for lam in (0.01, 0.1, 1.0, 10.0, 100.0):
        err = sum(_sse(grams[f], _solve(total - grams[f], 50, lam)).sum() for f in grams)
        rows.append((lam, round(float(1 - err / np.diag(total[50:, 50:]).sum()), 5)))
    best = max(rows, key=lambda r: r[1])[0]
    return spark.createDataFrame([(a, b, a == best) for a, b in rows], "lam double, r2 double, chosen boolean")


def ridge_bridge_loo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge with a free intercept within each level; leave-one-out residuals from the hat matrix, whose middle comes from sums by level."""
    c = G.concepts(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).select("id", "level", F.array(F.lit(1.0), *G.ESSENCE, *G.FUNCTION).alias("v"))
    reg = np.diag([0.0] + [0.1] * 7)
    sums = gram(c.select(F.col("level").cast("int").alias("fold"), "v"), 9)
    middle = {k: np.linalg.inv(g[:8, :8] + reg) for k, g in sums.items()}
    shared = spark.sparkContext.broadcast({k: (m, m @ sums[k][:8, 8:]) for k, m in middle.items()})  # two small matrices a level

    def residuals(batches):
        for pdf in batches:
            v = np.array(pdf.v.tolist(), float).reshape(len(pdf), -1)
            loo, pred = np.zeros((len(pdf), 7)), np.zeros((len(pdf), 7))
            for k, (m, w) in shared.value.items():
                at = (pdf.level == k).to_numpy()
                x, y = v[at, :8], v[at, 8:]
                loo[at] = (y - x @ w) / (1 - np.einsum("ij,jk,ik->i", x, m, x))[:, None]
                pred[at] = y - loo[at]
            y = v[:, 8:]
            size = np.linalg.norm(pred, axis=1) * np.linalg.norm(y, axis=1)
            t = np.degrees(np.arccos(np.clip((pred * y).sum(axis=1) / np.where(size == 0, 1, size), -1, 1)))
            yield pd.DataFrame({"id": pdf.id, "level": pdf.level, "loo_error": np.round(np.linalg.norm(loo, axis=1), 5), "own_angle": np.round(t, 3)})

    return c.mapInPandas(residuals, "id long, level long, loo_error double, own_angle double")


@unless_empty("embeddings", "axis string, r2 double")
def axis_r2_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out R2 of each axis over five contiguous folds, ridge of strength one, against the axis's mean."""
    rows = _projection_rows(spark, sf_dir, 5).select("fold", F.concat("v", F.array(F.lit(1.0))).alias("v"))
    grams = gram(rows, 5)
    total = sum(grams.values())
    err = np.zeros(14)
    for g in grams.values():
        w = _solve((total - g)[:64, :64], 50, 1.0)
        err += _sse(g[:64, :64], w)
    n = total[64, 64]
    sst = np.diag(total)[50:64] - total[64, 50:64] ** 2 / n
    return spark.createDataFrame([(k, round(float(1 - e / t), 5)) for k, e, t in zip(G.ESSENCE + G.FUNCTION, err, sst)], "axis string, r2 double")


@unless_empty("embeddings", "id long, nearest long, hit1 boolean, hit5 boolean, own_angle double")
def heldout_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Function vectors predicted from essences by a ridge fitted without their fold: angle to the own one, the nearest of all by blocked search, and hits at one and five."""
    e = G.concepts(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    rows = e.select("id", F.pmod(F.col("id"), F.lit(5)).cast("int").alias("fold"), F.array(F.lit(1.0), *G.ESSENCE, *G.FUNCTION).alias("v"))
    grams = gram(rows.select("fold", "v"), 5)
    total, reg = sum(grams.values()), np.diag([0.0] + [0.1] * 7)
    w = {f: np.linalg.solve((total - g)[:8, :8] + reg, (total - g)[:8, 8:]) for f, g in grams.items()}
    x = F.slice("v", 1, 8)
    pred = None
    for f, m in w.items():
        one = F.array(*[F.aggregate(F.zip_with(x, F.array(*map(F.lit, m[:, k].tolist())), lambda a, b: a * b), F.lit(0.0), lambda s, y: s + y) for k in range(7)])
        pred = F.when(F.col("fold") == f, one) if pred is None else pred.when(F.col("fold") == f, one)
    got = rows.select("id", pred.alias("vector"), F.slice("v", 9, 7).alias("own"))
    near = search.nearest(e.select("id", F.array(*G.FUNCTION).alias("vector")), got, 5, exclude_self=False)
    hits = near.groupBy("query_id").agg(F.min_by("id", "place").alias("nearest"), F.max((F.col("id") == F.col("query_id")) & (F.col("place") == 1)).alias("hit1"), F.max(F.col("id") == F.col("query_id")).alias("hit5"))
    return got.join(hits, got.id == hits.query_id).select("id", "nearest", "hit1", "hit5", F.round(G.array_angle(F.col("vector"), F.col("own")), 3).alias("own_angle"))


@unless_empty("embeddings", "level long, n long, read double, calibrated double, error double, band string")
def probe_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ridge probe of the first axis, read out of fold, its isotonic calibration from sums over fifty levels, and error by band of the read value."""
    rows = _projection_rows(spark, sf_dir, 5)
    grams = gram(rows, 5)
    total = sum(grams.values())
    w = {f: _solve((total - g)[:64, :64], 50, 1.0)[:, 0] for f, g in grams.items()}
    read = None
    for f, m in w.items():
        one = F.aggregate(F.zip_with(F.slice("v", 1, 50), F.array(*map(F.lit, m.tolist())), lambda a, b: a * b), F.lit(0.0), lambda s, y: s + y)
        read = F.when(F.col("fold") == f, one) if read is None else read.when(F.col("fold") == f, one)
    t = rows.select(read.alias("read"), F.element_at("v", 51).alias("y"))
    t = t.withColumn("level", F.greatest(F.lit(-25), F.least(F.lit(24), F.floor(F.col("read") * 100))))
    g = t.groupBy("level").agg(F.avg("y").alias("y"), F.count("*").alias("n"), F.avg("read").alias("read"), F.avg(F.abs(F.col("y") - F.col("read"))).alias("error")).orderBy("level").collect()  # 50 levels
    fitted = pav(np.array([r.y for r in g]), np.array([float(r.n) for r in g])) if g else []
    return spark.createDataFrame([(int(r.level), r.n, round(r.read, 5), round(float(a), 5), round(r.error, 5), "low" if r.read < -0.05 else "high" if r.read > 0.05 else "middle") for r, a in zip(g, fitted)], "level long, n long, read double, calibrated double, error double, band string")


#: Units of the network's layer, epochs at most, and epochs without a better validation error after which it ends.
HIDDEN, EPOCHS, PATIENCE = 128, 60, 10


def mlp_sums(p: list[np.ndarray], x: np.ndarray, y: np.ndarray, fit: np.ndarray) -> np.ndarray:
    """Sums over rows, flat: the squared error's gradient by all weights and the rows where ``fit``, the error and the rows elsewhere."""
    h = np.tanh(x @ p[0] + p[1])
    d = 2 * (h @ p[2] + p[3] - y)
    error = float((d[~fit] ** 2).sum()) / 4
    d, h, x = d[fit], h[fit], x[fit]
    back = (d @ p[2].T) * (1 - h * h)
    return np.concatenate([*(g.ravel() for g in (x.T @ back, back.sum(axis=0), h.T @ d, d.sum(axis=0))), [fit.sum(), error, (~fit).sum()]])


def mlp_train(sums, width: int, out: int, hidden: int = HIDDEN, epochs: int = EPOCHS, patience: int = PATIENCE) -> list[np.ndarray]:
    """Weights of a network of one tanh layer by Adam over all rows, those of the epoch with the least validation error; ``sums(p)`` takes :func:`mlp_sums` over the rows."""
    rng = np.random.default_rng(3)
    p = [rng.normal(0, width**-0.5, (width, hidden)), np.zeros(hidden), rng.normal(0, 0.1 * hidden**-0.5, (hidden, out)), np.zeros(out)]
    edges = np.cumsum([a.size for a in p])
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    best, kept, since = np.inf, p, 0
    for t in range(1, epochs + 2):
        got = sums(p)
        n, error, rest = got[-3:]
        if rest and error / rest < best:
            best, kept, since = error / rest, p, 0
        else:
            since += 1
        if since >= patience or not n:
            break
        new = []
        for k, g in enumerate(np.split(got[:-3], edges[:-1])):
            g = g.reshape(p[k].shape) / n
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
            new.append(p[k] - 0.02 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-9))
        p = new
    return kept


def mlp_fit(rows: DataFrame, width: int, **how) -> list[np.ndarray]:
    """:func:`mlp_train` over (v array<double>, fit boolean): each epoch is one pass whose sums Spark takes."""
    sc = rows.sparkSession.sparkContext

    def sums(p: list[np.ndarray]) -> np.ndarray:
        shared = sc.broadcast(p)  # some thousand weights

        def part(batches):
            total = 0.0
            for b in batches:
                v = search._matrix(b.column(0))
                if len(v):
                    total = total + mlp_sums(shared.value, v[:, :width], v[:, width:], b.column(1).to_numpy(zero_copy_only=False))
            if not np.isscalar(total):
                yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["g"])

        got = rows.select("v", "fit").mapInArrow(part, "g array<double>").select(F.posexplode("g").alias("pos", "g")).groupBy("pos").agg(F.sum("g").alias("g")).toPandas()  # as many rows as weights
        shared.unpersist()
        return got.sort_values("pos").g.to_numpy() if len(got) else np.zeros(sum(a.size for a in p) + 3)

    first = rows.select(F.size("v").alias("n")).first()
    return mlp_train(sums, width, (first.n if first else width + 1) - width, **how)


@unless_empty("embeddings", "axis string, n long, network_r2 double, linear_r2 double")
def mlp_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2 of each component by a small network beside the linear map, both fitted over all rows outside of a held-out fifth and read on that, from sums."""
    rows = keep(_projection_rows(spark, sf_dir, 1).withColumn("part", F.pmod(F.xxhash64("v"), F.lit(5))), "projection")
    net = mlp_fit(rows.where("part < 4").select("v", (F.col("part") < 3).alias("fit")), 50)
    linear = _solve(gram(rows.where("part < 4").select("fold", "v"), 1).get(0, np.eye(64)), 50, 1e-9)
    shared = spark.sparkContext.broadcast((net, linear))

    def errors(batches):
        net, linear = shared.value
        for b in batches:
            v = search._matrix(b.column(0))
            x, y = v[:, :50], v[:, 50:]
            if len(v):
                e1 = ((np.tanh(x @ net[0] + net[1]) @ net[2] + net[3] - y) ** 2).sum(axis=0)
                e2 = ((x @ linear - y) ** 2).sum(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(range(14), pa.int32()), pa.array(e1), pa.array(e2), pa.array(y.sum(axis=0)), pa.array((y * y).sum(axis=0)), pa.array([len(y)] * 14, pa.int64())], names=["j", "e1", "e2", "s", "ss", "n"])

    t = rows.where("part = 4").select("v").mapInArrow(errors, "j int, e1 double, e2 double, s double, ss double, n long").groupBy("j").agg(*[F.sum(c).alias(c) for c in ("e1", "e2", "s", "ss", "n")])
    sst = F.col("ss") - F.col("s") * F.col("s") / F.col("n")
    return t.select(F.element_at(F.array(*map(F.lit, G.ESSENCE + G.FUNCTION)), F.col("j") + 1).alias("axis"), "n", F.round(1 - F.col("e1") / F.nullif(sst, F.lit(0.0)), 4).alias("network_r2"), F.round(1 - F.col("e2") / F.nullif(sst, F.lit(0.0)), 4).alias("linear_r2"))


def logistic_fits(rows: DataFrame, steps: int = 12, ridge: float = 1e-3) -> dict[tuple, tuple[np.ndarray, np.ndarray]]:
    """(weights, inverse Hessian) by group and held-out fold (-1: none) of (g, fold, x array, y), by Newton steps whose sums Spark takes."""
    spark, d = rows.sparkSession, 3
    models = rows.select("g", F.explode(F.array(*[F.lit(f) for f in range(-1, 5)])).alias("out"), "fold", "x", "y").where("out <> fold")
    keys = [(r.g, r.out) for r in models.select("g", "out").distinct().collect()]  # groups x 6
    w = {k: np.zeros(d) for k in keys}
    h = {k: np.eye(d) for k in keys}
    for _ in range(steps):
        table = F.broadcast(spark.createDataFrame([(*k, [float(a) for a in v]) for k, v in w.items()], "g string, out int, w array<double>"))  # groups x 6
        z = sum((F.col("w")[i] * F.col("x")[i] for i in range(1, d)), F.col("w")[0] * F.col("x")[0])
        t = models.join(table, ["g", "out"]).withColumn("p", 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z)))))
        sums = [F.sum(F.col("x")[i] * (F.col("y") - F.col("p"))).alias(f"g{i}") for i in range(d)] + [F.sum(F.col("x")[i] * F.col("x")[j] * F.col("p") * (1 - F.col("p"))).alias(f"h{i}{j}") for i in range(d) for j in range(i, d)]
        most = 0.0
        for r in t.groupBy("g", "out").agg(*sums).collect():
            k = (r.g, r.out)
            h[k] = np.array([[r[f"h{min(i, j)}{max(i, j)}"] for j in range(d)] for i in range(d)]) + ridge * np.eye(d)
            step = np.linalg.solve(h[k], np.array([r[f"g{i}"] for i in range(d)]) - ridge * w[k])
            w[k] = w[k] + step
            most = max(most, float(np.abs(step).max()))
        if most < 1e-8:
            break
    return {k: (w[k], np.linalg.inv(h[k])) for k in keys}


def logistic_oof_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold AUROC of a logistic fit per language, folds by hash of the source, with Wald z and a null of labels permuted by hash."""
    l, d = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "documents"))
    marks = (F.length("text") - F.length(F.regexp_replace("text", "[.,]", ""))).cast("double")
    x = F.array(F.lit(1.0), F.log1p(F.coalesce("n_chars", F.lit(0)).cast("double")), F.log1p(F.coalesce(marks, F.lit(0.0))))
    rows = keep(d.join(l, "doc_id").where("quality IS NOT NULL").select("doc_id", F.coalesce("lang", F.lit("")).alias("g"), F.pmod(F.xxhash64("source"), F.lit(5)).cast("int").alias("fold"), x.alias("x"), F.col("quality").cast("double").alias("y")), "logistic")
    fits = logistic_fits(rows.select("g", "fold", "x", "y"))
    table = spark.createDataFrame([(g, f, [float(a) for a in w], float(w[1] / np.sqrt(c[1, 1]))) for (g, f), (w, c) in fits.items()], "g string, fold int, w array<double>, z double")  # groups x 6
    oof = rows.join(F.broadcast(table), ["g", "fold"]).select("doc_id", "g", "y", sum((F.col("w")[i] * F.col("x")[i] for i in range(1, 3)), F.col("w")[0] * F.col("x")[0]).alias("s"))
    same = Window.partitionBy("g").orderBy("s")
    ranked = oof.withColumn("rk", F.rank().over(same) + (F.count("*").over(Window.partitionBy("g", "s")) - 1) / 2).withColumn("at", F.row_number().over(Window.partitionBy("g").orderBy("doc_id")))
    drawn = ranked.select("g", "rk", "at", "doc_id", F.explode(F.sequence(F.lit(0), F.lit(40))).alias("b"))
    drawn = drawn.withColumn("to", F.row_number().over(Window.partitionBy("g", "b").orderBy(F.when(F.col("b") == 0, F.col("doc_id")).otherwise(F.xxhash64("b", "doc_id")), "doc_id")))
    t = drawn.select("g", "b", "rk", F.col("to").alias("at")).join(ranked.select("g", "at", "y"), ["g", "at"]).groupBy("g", "b").agg(F.count("*").alias("n"), F.sum("y").alias("pos"), F.sum(F.col("rk") * F.col("y")).alias("rs"))
    t = t.withColumn("auroc", (F.col("rs") - F.col("pos") * (F.col("pos") + 1) / 2) / F.nullif(F.col("pos") * (F.col("n") - F.col("pos")), F.lit(0.0)))
    out = t.groupBy("g").agg(F.max("n").alias("n"), F.max(F.when(F.col("b") == 0, F.col("auroc"))).alias("real"), F.sort_array(F.collect_list(F.when(F.col("b") > 0, F.col("auroc")))).alias("null"))
    z = table.where("fold = -1").select("g", F.round("z", 3).alias("z_length"))
    return out.join(F.broadcast(z), "g").select(F.col("g").alias("lang"), "n", F.round("real", 5).alias("auroc"), "z_length", F.when(F.col("real").isNotNull(), (1 + F.size(F.filter("null", lambda a: a >= F.col("real")))) / 41).alias("p_value"))


def act_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where acting becomes likelier than holding: a logistic fit of each arm over the rungs, from counts, and the rung where it crosses a half."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k"), "event_id")
    c = e.groupBy("event_type", (F.col("k") % 10).alias("rung")).agg(F.count("*").alias("n"), F.count_if((F.col("event_id") * 7 + F.col("k")) % 13 < F.col("k") % 10 + 2).alias("acts")).where("rung IS NOT NULL").collect()  # ten rungs an arm
    out = []
    for arm in sorted({r.event_type for r in c}):
        own = sorted((r.rung, r.n, r.acts) for r in c if r.event_type == arm)
        x, n, k = (np.array(v, float) for v in zip(*own))
        w, cov = _irls_counts(np.c_[np.ones(len(x)), x], n, k)
        out.append((arm, int(n.sum()), round(float(w[1]), 5), round(float(w[1] / np.sqrt(cov[1, 1])), 3), round(float(-w[0] / w[1]), 4) if w[1] else None))
    return spark.createDataFrame(out, "arm string, n long, slope double, z double, boundary double")


def _irls_counts(x: np.ndarray, n: np.ndarray, k: np.ndarray, ridge: float = 1e-6, steps: int = 50):
    """Logistic weights and inverse Hessian from (trials, successes) by row."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (k - n * p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-10:
            break
    return w, np.linalg.inv(h)


def _phi(z):
    return np.vectorize(lambda a: 0.5 * math.erfc(-a / math.sqrt(2)))(z)


def meta_loss(p: np.ndarray, counts: np.ndarray, ratio: float) -> float:
    """Negative log-likelihood of confidence given stimulus and answer; counts[stimulus, answer, confidence], p is meta-d' and the steps of the type-2 criteria on both sides."""
    k = counts.shape[2]
    mid = p[0] * ratio
    up = mid + np.r_[0, np.cumsum(np.exp(p[1:k]))]
    down = mid - np.r_[0, np.cumsum(np.exp(p[k : 2 * k - 1]))]
    total = 0.0
    for s, mean in enumerate((-p[0] / 2, p[0] / 2)):
        yes = np.diff(np.r_[_phi(up - mean), 1.0]) / max(1e-9, 1 - _phi(mid - mean))
        no = -np.diff(np.r_[_phi(down - mean), 0.0]) / max(1e-9, float(_phi(mid - mean)))
        total -= (counts[s, 1] * np.log(np.clip(yes, 1e-9, 1))).sum() + (counts[s, 0] * np.log(np.clip(no, 1e-9, 1))).sum()
    return float(total)


def meta_fit(counts: np.ndarray) -> tuple[float, float, float]:
    """(d', criterion, meta-d') of counts[stimulus, answer, confidence], by maximum likelihood."""
    c = counts + 0.5 / counts.shape[2]
    hit, fa = (c[s, 1].sum() / c[s].sum() for s in (1, 0))
    inv = NormalDist().inv_cdf
    d, crit = inv(hit) - inv(fa), -0.5 * (inv(hit) + inv(fa))
    k = counts.shape[2]
    ratio = crit / d if abs(d) > 1e-6 else 0.0
    best = _simplex(lambda p: meta_loss(p, c, ratio), np.r_[d, np.full(2 * k - 2, -0.7)], 1500)
    return float(d), float(crit), float(best[0])


def meta_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensitivity and metacognitive sensitivity of labels by language, from counts of four levels of confidence."""
    l, d = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "documents"))
    p = (F.col("n_chars") % 1000) / 1000 * 0.5 + F.col("quality") * 0.25
    t = d.join(l, "doc_id").where("quality IS NOT NULL AND n_chars IS NOT NULL").select(F.coalesce("lang", F.lit("")).alias("lang"), F.col("quality").alias("s"), (p >= 0.5).cast("int").alias("a"), F.least(F.lit(3), F.floor(F.abs(p - 0.5) * 16)).alias("c"))
    rows = t.groupBy("lang", "s", "a", "c").agg(F.count("*").alias("n")).collect()  # 16 a language
    out = []
    for lang in sorted({r.lang for r in rows}):
        counts = np.zeros((2, 2, 4))
        for r in rows:
            if r.lang == lang:
                counts[int(r.s), int(r.a), int(r.c)] = r.n
        if counts[0].sum() and counts[1].sum():
            d1, c1, m = meta_fit(counts)
            out.append((lang, int(counts.sum()), round(d1, 3), round(c1, 3), round(m, 2), round(m / d1, 2) if abs(d1) > 1e-6 else None))
    return spark.createDataFrame(out, "lang string, n long, d_prime double, criterion double, meta_d double, ratio double")


def pav(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Isotonic regression by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for v, n in zip(y, w):
        blocks.append([v, n, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, n2, c2 = blocks.pop()
            v1, n1, c1 = blocks.pop()
            blocks.append([(v1 * n1 + v2 * n2) / (n1 + n2), n1 + n2, c1 + c2])
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def isotonic_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Isotonic curve of quality on the score, from sums per level."""
    l, d = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "documents"))
    g = d.join(l, "doc_id").groupBy(F.floor((F.col("n_chars") % 1000) / 20).alias("level")).agg(F.avg("quality").alias("y"), F.count("*").alias("n")).orderBy("level").collect()  # 50 levels
    y = pav(np.array([r.y for r in g]), np.array([float(r.n) for r in g]))
    return spark.createDataFrame([(int(r.level), round(float(a), 6) + 0.0) for r, a in zip(g, y)], "level long, fitted double")


#: The same curve by its min-max form: the largest, over starts, of the smallest mean over ends.
ISOTONIC = """WITH g AS (SELECT CAST(floor((n_chars % 1000) / 20) AS BIGINT) AS level, sum(CAST(quality AS DOUBLE)) AS s, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1),
    c AS (SELECT level, sum(s) OVER w AS cs, sum(n) OVER w AS cn, s, n FROM g WINDOW w AS (ORDER BY level)), m AS (SELECT i.level AS i, j.level AS j, (j.cs - i.cs + i.s) / (j.cn - i.cn + i.n) AS a FROM c i JOIN c j ON i.level <= j.level),
    e AS (SELECT k.level, m.i, min(a) AS a FROM g k JOIN m ON m.i <= k.level AND m.j >= k.level GROUP BY k.level, m.i) SELECT level, round(max(a), 6) + 0e0 AS fitted FROM e GROUP BY level"""


def entropy_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the score's levels sharpened by bisection until their entropy is nine tenths of what it was."""
    g = spark.read.parquet(f"{sf_dir}/documents.parquet").where("n_chars IS NOT NULL").groupBy(F.floor((F.col("n_chars") % 1000) / 20).alias("level")).agg(F.count("*").alias("n")).orderBy("level").collect()  # 50 levels
    p = np.array([r.n for r in g], float) / max(1, sum(r.n for r in g))
    q = sharpened(p, 0.9)
    return spark.createDataFrame([(int(r.level), round(float(a), 6), round(float(b), 6)) for r, a, b in zip(g, p, q)], "level long, share double, sharpened double")


def sharpened(p: np.ndarray, part: float) -> np.ndarray:
    """Shares to a power, by bisection, whose entropy is ``part`` of that of ``p``."""
    entropy = lambda a: float(-(a[a > 0] * np.log(a[a > 0])).sum())
    want, lo, hi = entropy(p) * part, 1.0, 64.0
    for _ in range(60):
        mid = (lo + hi) / 2
        q = p**mid / (p**mid).sum()
        lo, hi = (mid, hi) if entropy(q) > want else (lo, mid)
    return p**lo / (p**lo).sum()


@unless_empty("embeddings", "id long, trigram string, predicted string, confidence double")
def softmax_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multinomial logistic of the class from the core, trained on even ids; odd ids scored at a fitted temperature."""
    c = G.concepts(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).select("id", "trigram", *G.ESSENCE)
    train = c.where("id % 2 = 0").orderBy(F.xxhash64("id")).limit(4000).toPandas()  # a bounded sample
    if not len(train):
        return c.where("id % 2 = 1").select("id", "trigram", F.lit(None).cast("string").alias("predicted"), F.lit(None).cast("double").alias("confidence"))
    names = sorted(train.trigram.unique())
    x = np.c_[np.ones(len(train)), train[list(G.ESSENCE)].to_numpy()]
    y = np.eye(len(names))[[names.index(t) for t in train.trigram]]
    w = np.zeros((x.shape[1], len(names)))
    for _ in range(400):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        w += 2.0 * (x.T @ (y - p) / len(x) - 1e-4 * w)
    temps = np.linspace(0.3, 3, 28)
    loss = []
    for t in temps:
        z = x @ w / t
        z -= z.max(axis=1, keepdims=True)
        loss.append(float((np.log(np.exp(z).sum(axis=1)) - (z * y).sum(axis=1)).mean()))
    t = float(temps[int(np.argmin(loss))])
    logits = [sum((float(w[i + 1, k]) * F.col(a) for i, a in enumerate(G.ESSENCE)), F.lit(float(w[0, k]))) / t for k in range(len(names))]
    best = F.greatest(*logits)
    pred = F.coalesce(*[F.when(z == best, F.lit(n)) for z, n in zip(logits, names)])
    total = sum((F.exp(z - best) for z in logits[1:]), F.exp(logits[0] - best))
    return c.where("id % 2 = 1").select("id", "trigram", pred.alias("predicted"), F.round(1 / total, 5).alias("confidence"))


def _simplex(f, x0: np.ndarray, steps: int = 400) -> np.ndarray:
    """A small Nelder-Mead."""
    pts = [x0] + [x0 + 0.2 * e for e in np.eye(len(x0))]
    vals = [f(p) for p in pts]
    for _ in range(steps):
        order = np.argsort(vals)
        pts, vals = [pts[i] for i in order], [vals[i] for i in order]
        c = np.mean(pts[:-1], axis=0)
        r = 2 * c - pts[-1]
        fr = f(r)
        if fr < vals[0]:
            e = 3 * c - 2 * pts[-1]
            fe = f(e)
            pts[-1], vals[-1] = (e, fe) if fe < fr else (r, fr)
        elif fr < vals[-2]:
            pts[-1], vals[-1] = r, fr
        else:
            k = (c + pts[-1]) / 2
            fk = f(k)
            if fk < vals[-1]:
                pts[-1], vals[-1] = k, fk
            else:
                pts = [pts[0]] + [(p + pts[0]) / 2 for p in pts[1:]]
                vals = [vals[0]] + [f(p) for p in pts[1:]]
    return pts[int(np.argmin(vals))]


@unless_empty("lineitem", "midpoint double, slope double, at_75 double, loss double")
def psychometric_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guess, lapse, midpoint and slope of accuracy over the level, and the level at 75 per cent, for hash-drawn answers."""
    o = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.floor("l_quantity").alias("level")).agg(F.avg((F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(100)) < 100 - 50 * F.exp(-F.col("l_quantity") / 15)).cast("double")).alias("acc"), F.count("*").alias("n")).orderBy("level").collect()  # 50 levels
    x, k, n = (np.array(v, float) for v in zip(*[(r.level, r.acc * r.n, r.n) for r in o]))

    def curve(p):
        guess, lapse = 0.5 / (1 + np.exp(-p[0])), 0.2 / (1 + np.exp(-p[1]))
        return guess + (1 - guess - lapse) / (1 + np.exp(-np.clip((x - p[2] * 10) * p[3], -50, 50)))

    def loss(p):
        c = np.clip(curve(p), 1e-6, 1 - 1e-6)
        return -(k * np.log(c) + (n - k) * np.log(1 - c)).sum()

    p = _simplex(loss, np.array([-4.0, -3.0, 2.5, 0.2]))
    c = curve(p)
    at = float(np.interp(0.75, c, x)) if c.max() > 0.75 else float("nan")
    return spark.createDataFrame([(round(float(p[2] * 10), 2), round(float(p[3]), 3), round(at, 2), round(float(loss(p) / n.sum()), 5))], "midpoint double, slope double, at_75 double, loss double")


def _graphs(spark: SparkSession, sf_dir: str, replicates: int) -> DataFrame:
    """What the rater graphs share (each line number a family, its edges suppliers with parts), and their null graphs."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    edges = rows.select(F.col("l_linenumber").alias("fam"), F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"))
    return rewiring.agreed(edges, replicates)


def edge_swap_null(spark: SparkSession, sf_dir: str, replicates: int = rewiring.REPLICATES) -> DataFrame:
    """Agreement of the families' graphs against graphs of the same degrees, mixed by curveball trades."""
    got = _graphs(spark, sf_dir, replicates).where("kind = 'rep'").groupBy("rep").agg(F.sum("n").alias("t"))
    every = spark.range(replicates + 1).select(F.col("id").alias("rep")).join(got, "rep", "left").select("rep", F.coalesce("t", F.lit(0)).alias("t"))  # a line a replicate
    real = every.where("rep = 0").select(F.col("t").alias("real"))
    null = F.col("rep") > 0
    return every.crossJoin(F.broadcast(real)).agg(
        F.max("real").alias("observed"), F.round(F.avg(F.when(null, F.col("t"))), 3).alias("null_mean"), F.max(F.when(null, F.col("t"))).alias("null_max"),
        F.round((1 + F.sum((null & (F.col("t") >= F.col("real"))).cast("int"))) / (replicates + 1), 6).alias("p_value"),
    )


def edge_swap_pairs(spark: SparkSession, sf_dir: str, replicates: int = rewiring.REPLICATES) -> DataFrame:
    """Each edge that several families share, and the share of null graphs in which at least as many do."""
    got = _graphs(spark, sf_dir, replicates).where("kind = 'pair'").groupBy("a", "b", F.col("rep").alias("families")).agg(F.sum("n").alias("hits"))
    return got.select("a", "b", "families", F.round((1 + F.col("hits")) / (replicates + 1), 6).alias("p_value"))


SHIFTS, BLOCK = 60, 4096


def relabel_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out fit of a fixed hat matrix under cyclic derangements of the labels, from sums over blocks of all rows."""
    c = G.concepts(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    v = ordered.row_numbers(c.select("id", F.array(F.lit(1.0), *G.ESSENCE).alias("x"), F.array(*G.FUNCTION).alias("y")), ["id"], "i").select((F.col("i") - 1).alias("i"), "x", "y")
    n = c.count()
    a = gram(v.select(F.lit(0).alias("fold"), F.col("x").alias("v")), 1).get(0, np.zeros((8, 8))) + 0.1 * np.eye(8)
    inverse = np.linalg.inv(a)
    # a row goes to all blocks in which one of its shifted places lies
    places = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(SHIFTS - 1)), lambda s: F.floor(((F.col("i") + s) % F.lit(max(1, n))) / BLOCK)))

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        at, x, y = pdf.i.to_numpy(), np.array(pdf.x.tolist()), np.array(pdf.y.tolist())
        own = at // BLOCK == pdf.b.iloc[0]
        x, mine = x[own], at[own]
        u = 1 / (1 - np.einsum("ij,jk,ik->i", x, inverse, x)) ** 2
        out = [(u[:, None] * x).T @ x]
        for s in range(SHIFTS):
            ys = y[np.searchsorted(at, (mine - s) % n)]
            out += [x.T @ ys, (u[:, None] * x).T @ ys, np.array([(u[:, None] * ys * ys).sum()])]
        return pd.DataFrame({"g": [np.concatenate([m.ravel() for m in out]).tolist()]})

    parts = v.select("*", F.explode(places).alias("b")).groupBy("b").applyInPandas(sums, "g array<double>")
    got = parts.select(F.posexplode("g").alias("pos", "g")).groupBy("pos").agg(F.sum("g").alias("g")).orderBy("pos").collect()
    t = np.array([r.g for r in got]) if got else np.zeros(64 + SHIFTS * 113)
    weighted, rows = t[:64].reshape(8, 8), []
    for b in t[64:].reshape(SHIFTS, 113):
        w = inverse @ b[:56].reshape(8, 7)
        rows.append(round(float(b[112] - 2 * (w * b[56:112].reshape(8, 7)).sum() + np.einsum("ij,ik,kj->", w, weighted, w)), 5))
    return spark.createDataFrame([(rows[0], round(float(np.mean(rows[1:])), 5), (1 + sum(r <= rows[0] for r in rows[1:])) / 60)], "observed double, null_mean double, p_value double")


def constrained_cores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cores moved, by 80 restarts and gradient steps, to stand at 90 degrees to their complements; every concept by itself."""
    c = G.concepts(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    anchors = {r.id: (r.x, r.y, r.z) for r in c.where("id % 50 < 3").select("id", "x", "y", "z").where("id < 500").collect()}  # 30 rows

    def solve(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                t = np.array([anchors[k] for k in ((r.id % 10) * 50 + i for i in range(3)) if k in anchors]).reshape(-1, 3)
                t /= np.linalg.norm(t, axis=1, keepdims=True)
                start = np.array([r.x, r.y, r.z])
                v = start + np.r_[np.zeros((1, 3)), np.random.default_rng(int(r.id)).normal(0, 0.3, (79, 3))]
                v /= np.maximum(1e-9, np.linalg.norm(v, axis=1, keepdims=True))
                for _ in range(50):
                    v = v - 0.2 * (v @ t.T) @ t
                    v /= np.maximum(1e-9, np.linalg.norm(v, axis=1, keepdims=True))
                loss = ((v @ t.T) ** 2).sum(axis=1) + 0.001 * ((v - start) ** 2).sum(axis=1)
                k = int(loss.argmin())
                out.append((int(r.id), *(round(float(a), 6) for a in v[k]), round(float(loss[k]), 6)))
            yield pd.DataFrame(out, columns=["id", "x", "y", "z", "loss"])

    return c.select("id", "x", "y", "z").repartition("id").mapInPandas(solve, "id long, x double, y double, z double, loss double")


#: Degrees under which a new concept is too near to an old one or to one added before it.
TOO_NEAR = 15.0


def insert_batches(old: search.AngularIndex, rows: DataFrame, limit: float = TOO_NEAR) -> DataFrame:
    """(batch, id, nearest, state) of ``rows`` (batch, id, vector), each batch checked by itself; what is added is appended to ``old``.

    First all rows of a batch are checked against the old index: one too near, and the
    whole batch is ``rejected``. Then its rows go in one by one in the order of ids: ``added``,
    or ``near`` if a row added before is under ``limit`` degrees away. The second pass is the
    first-fit set of the conflict graph, found in parallel rounds. Ids are unique over all batches.
    """
    rows = keep(rows.select(F.col("batch").cast("long").alias("batch"), F.col("id").cast("long").alias("id"), "vector"), "batch")
    near = keep(old.nearest(rows, 1, exclude_self=False, digits=None).select(F.col("query_id").alias("id"), F.col("angle").alias("nearest")), "nearest")
    checked = keep(rows.join(near.hint("merge"), "id", "left"), "checked")
    bad = checked.where(F.col("nearest") < limit).select("batch").distinct()
    fit = keep(checked.join(bad.hint("merge"), "batch", "left_anti"), "fit")
    own = search.AngularIndex.build(fit, group="batch")
    pairs = own.within(fit, 0.0, float(np.nextafter(limit, 0)), group="batch", once=True).select(F.col("query_id").alias("a"), F.col("id").alias("b"))
    state = keep(rewiring.first_fit(fit, pairs).select("id", F.when(F.col("added"), "added").otherwise("near").alias("state")), "state")
    old.append(fit.join(state.where("state = 'added'").hint("merge"), "id", "left_semi"))
    return checked.join(state.hint("merge"), "id", "left").select("batch", "id", F.round("nearest", 4).alias("nearest"), F.coalesce("state", F.lit("rejected")).alias("state"))


def batch_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fortieth concept, and a slightly turned copy of it, in batches of four against all others; ``found`` tells whether the grown index gives a row back as its own nearest."""
    c = G.concepts(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).select("id", F.array(*G.ESSENCE).alias("vector"))
    index = search.AngularIndex.build(c.where("id % 40 <> 0"))
    asked = c.where("id % 40 = 0").select(F.floor(F.col("id") / 80).alias("batch"), F.explode(F.array(F.lit(0), F.lit(1))).alias("turned"), "id", "vector")
    turned = F.zip_with("vector", F.reverse("vector"), lambda x, y: x + 0.05 * y)
    asked = asked.select("batch", (F.col("id") + F.col("turned") * F.lit(1 << 40)).alias("id"), F.when(F.col("turned") == 1, turned).otherwise(F.col("vector")).alias("vector"))
    got = keep(insert_batches(index, asked), "inserted")
    again = index.nearest(asked, 1, exclude_self=False).select(F.col("query_id").alias("id"), (F.col("query_id") == F.col("id")).alias("found"))
    return got.join(again.hint("merge"), "id", "left")


QUERIES = {
    "ols_projection_r2": ("PRJN-02", ols_projection_r2, None),
    "ridge_cv": ("PRJN-03", ridge_cv, None),
    "axis_r2_cv": ("PRJN-14", axis_r2_cv, None),
    "ridge_bridge_loo": ("PRJN-12 PRJN-13", ridge_bridge_loo, None),
    "heldout_transfer": ("PRJN-15", heldout_transfer, None),
    "probe_calibration": ("PRJN-16", probe_calibration, None),
    "mlp_projection": ("PRJN-08", mlp_projection, None),
    "logistic_oof_auroc": ("STAT-02 STAT-03 STAT-26", logistic_oof_auroc, None),
    "act_boundary": ("STAT-25", act_boundary, None),
    "meta_sensitivity": ("STAT-13", meta_sensitivity, None),
    "isotonic_fit": ("STAT-19", isotonic_fit, ISOTONIC),
    "entropy_matched": ("STAT-22", entropy_matched, None),
    "softmax_bar": ("PRJN-17", softmax_bar, None),
    "psychometric_fit": ("PRJN-18", psychometric_fit, None),
    "edge_swap_null": ("STAT-48", edge_swap_null, None),
    "edge_swap_pairs": ("STAT-48", edge_swap_pairs, None),
    "relabel_null": ("STAT-38", relabel_null, None),
    "constrained_cores": ("CUR-10", constrained_cores, None),
    "batch_insert": ("CUR-03 CUR-09 STR-07", batch_insert, None),
}
