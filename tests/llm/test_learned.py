"""Language, toxicity and page extraction: held-out accuracy and planted cases."""

import random

import pytest
from pyspark.sql import functions as F

from arcweave.llm import html, langid, queries, toxicity

from .helpers import documents

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    got = queries.op1_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    acc = {r.held_out: r.a for r in got.groupBy("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a")).collect()}
    assert acc[True] > 0.98 and acc[False] > 0.98
    assert got.where("score < 0 OR score > 1 OR lang_pred IS NULL").count() == 0


def test_language_edges(spark):
    model = langid.learn(spark.read.parquet(f"{SF}/documents.parquet"))
    docs = documents(spark, [None, "", "123 !? \n", "der die das und nicht", "x" * 3_000_000, "ß"])
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in range(3)) and got[3].lang_pred == "de" and got[4].lang_pred != "und"
    empty = langid.learn(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(docs, empty).collect()} == {"und"}


def test_window_joins_add_up(monkeypatch):
    e = langid.Encoder()
    text = "the quick brown fox " * 50
    whole = e.vectors([text])
    monkeypatch.setattr(langid, "WINDOW", 64)
    assert abs(e.vectors([text]) - whole).max() < 1e-3


def planted(n=900):
    rng = random.Random(5)
    texts, toxic = [], []
    for i in range(n):
        s = [" ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) for _ in range(rng.randint(3, 12))) for _ in range(rng.randint(1, 12))]
        y = int(rng.random() < 0.25)
        if y:
            k = rng.randrange(len(s))
            s[k] = s[k] + " " + rng.choice(["zornig", "zornigst", "vile"])
        texts.append(". ".join(s) + ".")
        toxic.append(y)
    return texts, toxic


def test_toxicity_learns_and_locates(spark):
    texts, toxic = planted()
    docs = documents(spark, texts + [None, "", "!!!"])
    labels = spark.createDataFrame([(i, y, 0) for i, y in enumerate(toxic)] + [(1, None, 0), (10**6, 1, 0)], "doc_id long, toxic int, quality int")
    got = {r.doc_id: r for r in toxicity.toxicity_query(docs, labels).collect()}
    assert sum(got[i].predicted == y for i, y in enumerate(toxic)) > 0.98 * len(toxic)
    assert got[len(texts)].score == got[len(texts) + 1].score == 0.0 and got[len(texts) + 2].score < 0.5 and all(0 <= r.score <= 1 for r in got.values())
    model = toxicity.learn(docs, labels)
    hits = toxicity.offending(docs, model).collect()
    assert hits and all("zornig" in h.text or "vile" in h.text for h in hits)
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns
    left = {r.doc_id for r in kept.collect()}
    assert sum(i in left for i, y in enumerate(toxic) if not y) > 0.99 * toxic.count(0) and {len(texts), len(texts) + 1} <= left
    assert sum(i in left for i, y in enumerate(toxic) if y) < 0.05 * toxic.count(1)


def test_toxicity_without_labels(spark):
    docs = documents(spark, ["a b", None])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.toxicity_query(docs, none).collect()} == {0.0}


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header class="site-header"><div class="logo">Brand</div><nav><ul><li><a href="/">Home</a><li><a href="/x">Section</a></ul></nav></header>
<div class="cookie-notice">We use cookies. Accept them all.</div>
<article class="post"><h1>A  title &amp; more</h1><p>First paragraph of the story,
with <b>bold</b> and <a href="x">a link</a> inside.<p>Second one has several sentences. They go on. And on.</p>
<div class="ad">Buy now, it is cheap. Really cheap.</div><ul><li>First point of the list, which is long.</li><li>Second point of the list, as long.</li></ul></article>
<aside class="sidebar"><h3>Related</h3><ul><li><a href="/a">Other</a></li></ul></aside>
<section class="comments"><h3>Comments</h3><p>I disagree with all of this, it is wrong. Really.</p></section>
<form><label>Mail</label><input><button>Send</button></form><footer>&copy; 2020 Brand. All rights reserved.</footer></body></html>"""


@pytest.fixture(scope="module")
def extractor():
    return html.Extractor()


def test_planted_page(extractor):
    assert extractor.texts([PAGE])[0].split("\n") == [
        "A title & more",
        "First paragraph of the story, with bold and a link inside.",
        "Second one has several sentences. They go on. And on.",
        "First point of the list, which is long.",
        "Second point of the list, as long.",
    ]


def test_held_out_layouts(extractor):
    pages = html.labelled_pages(150, seed=77)
    forest = html.Forest([html.parse(p)[0] for p in pages], extractor.index)
    p, _ = forest.marginals(extractor.w, extractor.pair)
    assert ((p >= 0.5) == forest.label).mean() > 0.97


def test_sum_product_is_exact(extractor):
    """Marginals of a small tree by enumeration."""
    import itertools

    import numpy as np

    nodes = html.parse("<div><p>one two.</p><ul><li>a</li></ul></div>")[0]
    f = html.Forest([nodes], extractor.index)
    u = np.bincount(f.rows, extractor.w[f.cols], minlength=f.n)
    total, on = 0.0, np.zeros(f.n)
    for y in itertools.product((0, 1), repeat=f.n):
        s = np.exp(sum(u[i] * y[i] for i in range(f.n)) + sum(extractor.pair[f.kind[i], y[f.parent[i]], y[i]] for i in range(f.n) if f.parent[i] >= 0))
        total += s
        on += s * np.array(y)
    assert np.allclose(on / total, f.marginals(extractor.w, extractor.pair)[0])


def test_page_edges(spark):
    rows = [(1, "u", PAGE, "x"), (2, None, None, "x"), (3, "u", "", "x"), (4, "u", "<p", "x"), (5, "u", "plain words", "x"), (6, "u", "<article><p>" + "Long text here. " * 50_000, "x")]
    got = {r.page_id: r for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert got[2].text == got[3].text == got[4].text == "" and got[2].url is None and got[6].n_chars == 799_999
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string").limit(0)).count() == 0


def test_language_equals_a_naive_encoder(spark):
    """Letter by letter and trigram by trigram: the same prototypes, predictions and scores."""
    import zlib

    import numpy as np

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text", "lang").collect()
    rng = random.Random(1)
    odd = ["Ünïcödé Straße", "日本 語の文", "Ελλάδα και θάλασσα", "a", "ab", "İstanbul", None, "12 3"]
    letter = {}

    def encode(text):
        sym = [c if c.isalpha() else " " for c in f" {text.lower()} "]
        sym = [c for k, c in enumerate(sym) if c != " " or k == 0 or sym[k - 1] != " "]
        out = np.zeros(langid.DIM)
        for x, y, z in zip(sym, sym[1:], sym[2:]):
            if (x, y, z) != (" ", " ", " "):
                v = [letter.setdefault(c, langid.letter_vector(0 if c == " " else ord(c)).astype(int)) for c in (x, y, z)]
                out += np.roll(v[0], 2) * np.roll(v[1], 1) * v[2]
        return out / (np.linalg.norm(out) or 1)

    train = [r for r in rows if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    langs = sorted({r.lang for r in train})
    proto = np.array([sum(encode(r.text) for r in train if r.lang == x) for x in langs])
    proto /= np.linalg.norm(proto, axis=1, keepdims=True)
    got = {r.doc_id: r for r in queries.op1_language_id(spark, "/root/testdata/sf0.001").collect()}
    model = langid.learn(docs.where("crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2"))
    extra = {r.doc_id: r for r in langid.identify(documents(spark, odd), model).collect()}
    for text, r in [(x.text, got[x.doc_id]) for x in rng.sample(rows, 60)] + [(t, extra[i]) for i, t in enumerate(odd)]:
        v = encode(text or "")
        cos = proto @ v
        assert r.score == pytest.approx(max(0, cos.max()) if v.any() else 0, abs=2e-5)
        assert r.lang_pred == (langs[int(cos.argmax())] if v.any() else "und") or np.sort(cos)[-2:].ptp() < 1e-5


def test_toxicity_gradient_and_scores():
    """The gradient against differences, and a score sentence by sentence."""
    import numpy as np

    rng = np.random.default_rng(3)
    docs = []
    for _ in range(30):
        sizes = rng.integers(1, 5, rng.integers(0, 4)).astype("<u4")
        docs.append((int(rng.random() < 0.4), int(rng.integers(0, 3)), sizes.tobytes(), rng.integers(0, 6, int(sizes.sum())).astype("<u4").tobytes()))
    theta = rng.normal(0, 0.5, 7)
    value, g = toxicity.loss(theta, docs)
    for k in range(7):
        step = np.zeros(7)
        step[k] = 1e-5
        assert g[k] == pytest.approx((toxicity.loss(theta + step, docs)[0] - toxicity.loss(theta - step, docs)[0]) / 2e-5, abs=1e-6)
    naive = 0.0
    for y, empty, n, f in docs:
        f, p, at = np.frombuffer(f, "<u4"), (1 / (1 + np.exp(theta[-1]))) ** empty, 0
        for size in np.frombuffer(n, "<u4"):
            p *= 1 / (1 + np.exp(theta[-1] + theta[f[at : at + size]].sum()))
            at += size
        naive -= np.log(1 - p if y else p) / len(docs) if 0 < p < 1 or not y else np.log(1e-9) / len(docs)
    assert value == pytest.approx(naive, abs=1e-6)
    model = toxicity.Model({"=vile": 3.0, "^vile": 1.0, "=kind": -2.0}, -2.0)
    text = "A vile word. A kind, vilest one! plain\nVILE kind words"
    z = [-2 + 3, -2 - 2 + 1, -2, -2 + 3 - 2]
    want = 1 - np.prod([1 - 1 / (1 + np.exp(-x)) for x in z])
    assert model.scores([text, ""]).tolist() == pytest.approx([want, 0.0], abs=1e-5)
    assert model.sentence_scores(text) == pytest.approx([1 / (1 + np.exp(-x)) for x in z])


def test_toxicity_bounds_and_odd_rows(spark):
    texts, toxic = planted(300)
    docs = documents(spark, [*texts, "vile thing.", None, "zornig " * 50_000], ids=[*range(300), None, None, 5]).withColumnsRenamed({"_id": "score", "_text": "_y"})
    labels = spark.createDataFrame([(i, y) for i, y in enumerate(toxic)] + [(None, 1)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels, sample_bytes=20_000)
    assert model.weights and all(w for w in model.weights)
    got = toxicity.score(docs, model)
    assert got.count() == 303 and got.where("doc_id IS NULL").count() == 2
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns and {(r.score, r._y) for r in kept.collect()} == {("x", "y")}
    assert toxicity.score(docs.limit(0), model).count() == 0 and toxicity.learn(docs, labels, sample_rows=0).weights == {}


def test_a_very_long_text_leaves_the_lesson(spark):
    texts, toxic = planted(300)
    first = spark.range(300).orderBy(F.xxhash64("id")).first().id
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    for size in (39_000, 80_000):  # under the bound, and over it
        odd = [("plain word. " * (size // 12)) if i == first else t for i, t in enumerate(texts)]
        model = toxicity.learn(documents(spark, odd), labels, sample_bytes=40_000)
        want = toxicity.learn(documents(spark, texts), labels, sample_bytes=40_000)
        assert model.weights and len(model.weights) > 0.5 * len(want.weights)
