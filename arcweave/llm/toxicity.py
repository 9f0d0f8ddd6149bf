"""Toxicity by multiple-instance learning.

Only documents carry labels. A sentence's score is a logistic function of its
words' features (the word, and its prefixes of four to seven letters), and a
document's score is the noisy-or of its sentences: one toxic sentence is
enough. Both are trained together from document labels by maximum likelihood,
on at most ``sample_rows`` labelled documents of at most ``sample_bytes``
together, those with the smallest hash of the id; features are the ``features``
ones that lean most to either label. These three bounds are parameters of the
classifier. The trained model then scores every sentence of every whole text and
locates the offending ones.

Defined cases: null and empty texts have no sentence and score 0; labels that
are null, and documents without a label, teach nothing; repeated labels count
once, by their largest; features that lean equally are taken in the order of
their letters; rows that share an id are scored each, and learned from each; a
row without an id is scored and teaches nothing; texts of any length are scored
whole; without any training row every score is 0; an empty table gives no rows;
other columns are not read, and pass unchanged through :func:`keep_clean`.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Labelled documents that the model is learned from, their bytes, and features kept, at most.
SAMPLE_ROWS, SAMPLE_BYTES, FEATURES = 20_000, 256 << 20, 20_000
LEAST_DOCS, LEAST_Z = 5, 3.0
STEPS, RATE, RIDGE = 300, 0.08, 2e-4
CACHE = 300_000
_WORD = re.compile(r"[^\W\d_]+")
_LINE = re.compile(r"[\n\r]+")
_END = re.compile(r"[.!?]$")


def features(token: str) -> list[str]:
    out = []
    for w in _WORD.findall(token.lower()):
        out.append("=" + w)
        out.extend("^" + w[:n] for n in range(4, min(8, len(w))))
    return out


def sentences(text: str) -> list[list[str]]:
    """White-space tokens by sentence; a sentence ends with . ! ? or the line."""
    out = []
    for line in _LINE.split(text):
        own: list[str] = []
        for t in line.split():
            own.append(t)
            if t[-1] in ".!?":
                out.append(own)
                own = []
        if own:
            out.append(own)
    return out


def _noisy_or(z: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """1 - prod(1 - sigmoid(z)) of each run of sentences."""
    return -np.expm1(np.add.reduceat(-np.logaddexp(0, z), starts))


def loss(theta: np.ndarray, docs: list[tuple[int, int, bytes, bytes]]) -> tuple[float, np.ndarray]:
    """Mean negative log-likelihood of the labels and its gradient; docs are (label, sentences without a feature, features by sentence, feature ids), theta is the weights and the bias."""
    return _loss(theta, *_flat(docs))


def _flat(docs):
    y = np.array([d[0] for d in docs], float)
    empty = np.array([d[1] for d in docs], float)
    sizes = [np.frombuffer(d[2], "<u4") for d in docs]
    doc_of = np.repeat(np.arange(len(docs)), [len(s) for s in sizes])
    flat = np.concatenate(sizes)
    sent = np.repeat(np.arange(len(flat)), flat)
    feat = np.concatenate([np.frombuffer(d[3], "<u4") for d in docs]).astype(np.int64)
    return y, empty, doc_of, len(flat), sent, feat


def _loss(theta, y, empty, doc_of, n, sent, feat):
    w, b = theta[:-1], theta[-1]
    z = b + np.bincount(sent, w[feat], minlength=n)
    clean = -np.bincount(doc_of, np.logaddexp(0, z), minlength=len(y)) - empty * np.logaddexp(0, b)  # log of no toxic sentence
    p = np.clip(-np.expm1(clean), 1e-9, 1 - 1e-9)
    by_doc = np.where(y == 1, -(1 - p) / p, 1.0) / len(y)
    dz = by_doc[doc_of] * np.exp(-np.logaddexp(0, -z))
    g = np.r_[np.bincount(feat, dz[sent], minlength=len(w)), dz.sum() + (by_doc * empty).sum() * np.exp(-np.logaddexp(0, -b))]
    return float(-np.where(y == 1, np.log(p), clean).mean()), g


def fit(docs: list[tuple[int, int, bytes, bytes]], width: int) -> tuple[np.ndarray, float]:
    """Weights and bias by gradient descent (Adam) on the document likelihood."""
    flat = _flat(docs)
    theta = np.r_[np.zeros(width), -5.0]
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, STEPS + 1):
        g = _loss(theta, *flat)[1]
        g[:-1] += RIDGE * theta[:-1] / 10
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return theta[:-1], float(theta[-1])


class Model:
    """Weights by feature; scores sentences and texts."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.token: dict[str, float] = {}

    def weight(self, token: str) -> float:
        got = self.token.get(token)
        if got is None:
            if len(self.token) >= CACHE:
                self.token.clear()
            got = self.token[token] = sum([self.weights.get(f, 0.0) for f in features(token)])
        return got

    def sentence_scores(self, text: str) -> list[float]:
        if not self.weights:
            return []
        z = [self.bias + sum([self.weight(t) for t in s]) for s in sentences(text)]
        return (1 / (1 + np.exp(-np.array(z)))).tolist() if z else []

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts))
        if not self.weights:
            return out
        z, starts, own = [], [], []
        store, weight, bias = self.token, self.weight, self.bias
        for i, text in enumerate(texts):
            at = len(z)
            for line in _LINE.split(text):
                total, some = bias, False
                for t in line.split():
                    got = store.get(t)
                    total += weight(t) if got is None else got
                    some = True
                    if t[-1] in ".!?":
                        z.append(total)
                        total, some = bias, False
                if some:
                    z.append(total)
            if len(z) > at:
                starts.append(at)
                own.append(i)
        if z:
            out[own] = _noisy_or(np.array(z), np.array(starts))
        return np.round(np.clip(out, 0, 1), 6)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES, n_features: int = FEATURES) -> Model:
    """Train on at most ``sample_rows`` labelled documents of ``docs``, as far as ``sample_bytes`` go; where they do not reach for all, very long texts are left out first."""
    spark = docs.sparkSession
    common.small_batches(spark)
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{label_col}`").cast("int").alias("_y")).where("_id IS NOT NULL AND _y IS NOT NULL").groupBy("_id").agg(F.max("_y").alias("_y"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)  # bounded, so it may be broadcast
    rows = common.texts(docs, id_col, text_col).join(F.broadcast(known), "_id").repartition(min(16, common.parts(spark)), "_id").sortWithinPartitions("_id").select("_id", "_text", "_y")
    rows = common.stage(rows, "toxic-sample")
    size = F.octet_length("_text")
    if (rows.agg(F.sum(size)).first()[0] or 0) > sample_bytes:
        # in the order of the sample, but texts of over a sixteenth of the bound come last, so that none crowds out the others; a table of at most sample_rows ids
        so_far = F.sum(size).over(Window.orderBy(size > sample_bytes // 16, F.xxhash64("_id"), "_id"))
        fits = rows.select("_id", so_far.alias("_bytes")).where(F.col("_bytes") <= sample_bytes).select("_id").distinct()
        fewer = common.stage(common.again(rows).join(F.broadcast(fits), "_id", "left_semi").repartition(min(16, common.parts(spark)), "_id").sortWithinPartitions("_id"), "toxic-sample")
        common.discard(rows)
        rows = fewer
    table, rows = rows, rows.select("_text", "_y")

    def count(batches):
        seen: Counter = Counter()
        pos: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64()), pa.array([pos[k] for k in seen], pa.int64())], names=["f", "n", "pos"])

        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got = {f for t in set(text.decode("utf-8", "replace").split()) for f in features(t)}
                seen.update(got)
                if y:
                    pos.update(got)
            if len(seen) > 400_000:
                yield out()
                seen.clear()
                pos.clear()
        yield out()

    n, p = rows.agg(F.count("*"), F.avg(F.col("_y").cast("double"))).first()
    if not n or not 0 < p < 1:
        common.discard(table)
        return Model({}, 0.0)
    lean = rows.mapInArrow(count, "f string, n long, pos long").groupBy("f").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).where(F.col("n") >= LEAST_DOCS)
    lean = lean.withColumn("z", (F.col("pos") - F.col("n") * p) / F.sqrt(F.col("n") * F.lit(p * (1 - p)))).where(F.abs("z") >= LEAST_Z)
    kept = [r.f for r in lean.orderBy(F.desc(F.abs("z")), "f").limit(n_features).select("f").collect()]
    index = {f: i for i, f in enumerate(kept)}
    shared = spark.sparkContext.broadcast(index)

    def encode(batches):
        index = shared.value
        for b in batches:
            out = []
            for text in b.column(0).to_pylist():
                own = [[index[f] for t in s for f in features(t) if f in index] for s in sentences(text.decode("utf-8", "replace"))]
                out.append((sum(not s for s in own), np.array([len(s) for s in own if s], "<u4").tobytes(), np.array([f for s in own for f in s], "<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary()), pa.array([o[2] for o in out], pa.binary())], names=["y", "empty", "n", "s"])

    coded = [(r.y, r.empty, bytes(r.n), bytes(r.s)) for r in rows.mapInArrow(encode, "y int, empty long, n binary, s binary").collect() if r.n or r.empty]  # at most sample_rows of sample_bytes
    common.discard(table)
    if not coded:
        return Model({}, 0.0)
    coded.sort()
    w, b = fit(coded, len(index))
    return Model({f: round(float(x), 6) for f, x in zip(kept, w)}, round(float(b), 6))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted of every whole text."""
    common.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # n_features entries at most

    def run(batches):
        own = Model(*shared.value)
        for b in batches:
            s = own.scores([t.decode("utf-8", "replace") for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())], names=["doc_id", "score", "predicted"])

    return common.texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, predicted int")


def offending(docs: DataFrame, model: Model, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, sentence (its place), score, text of the sentences that score ``least`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches):
        own = Model(*shared.value)
        for b in batches:
            rows = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                text = text.decode("utf-8", "replace")
                for k, (s, words) in enumerate(zip(own.sentence_scores(text), sentences(text))):
                    if s >= least:
                        rows.append((i, k, round(s, 6), " ".join(words)))
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.float64(), pa.string()))], names=["doc_id", "sentence", "score", "text"])

    return common.texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, sentence int, score double, text string")


def toxicity_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn where crc32(doc_id) mod 5 is not 0 and score every document."""
    held_out = common.crc_mod(F.col("doc_id"), 5) == 0
    model = learn(docs, labels.where(~held_out))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def keep_clean(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, unchanged, whose text scores under ``least``."""
    held_out = common.crc_mod(F.col("doc_id"), 5) == 0
    model = learn(docs, labels.where(~held_out))
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    at = docs.columns.index("text")
    common.small_batches(docs.sparkSession)

    def run(batches):
        own = Model(*shared.value)
        for b in batches:
            s = own.scores([t or "" for t in b.column(at).to_pylist()])
            yield b.filter(pa.array(s < least))

    return docs.mapInArrow(run, docs.schema)
