import numpy as np
import pytest

from arcweave.llm import jaccard
from arcweave.llm.components import components

from .helpers import corpus, documents

LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    out, own = [], ""
    for ch in (text or "").translate(LOWER):
        if ch in " \t\n\x0b\x0c\r":
            if own:
                out.append(own)
            own = ""
        else:
            own += ch
    return out + [own] if own else out


def shingles(text):
    w = words(text)
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(texts):
    sets = [shingles(t) for t in texts]
    comp = list(range(len(texts)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                comp[b] = a
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    texts = corpus(seed)
    got = sorted(map(tuple, jaccard.similar_components(documents(spark, texts)).collect()))
    assert got == brute(texts)


def test_frequent_tokens_alone(spark, monkeypatch):
    """Every token frequent, every list long: pairs of classes carry the join."""
    monkeypatch.setattr(jaccard, "RARE", 1)
    monkeypatch.setattr(jaccard, "SMALL", 2)
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    texts = corpus(3)
    assert sorted(map(tuple, jaccard.similar_components(documents(spark, texts)).collect())) == brute(texts)


def test_hot_keys_change_nothing(spark, monkeypatch):
    """Every shared token hot, every list split, every bundle in blocks."""
    for name, value in dict(RARE=1, SMALL=2, BLOCK=3, LIST=3, SAMPLE=1, LEAST=3, PLANS=0, TIES=20).items():
        monkeypatch.setattr(jaccard, name, value)
    texts = corpus(6)
    docs = documents(spark, texts)
    assert len(jaccard.hot_tokens(jaccard.common.texts(docs, "doc_id", "text"))) > 50
    assert sorted(map(tuple, jaccard.similar_components(docs).collect())) == brute(texts)


def test_rows_without_an_id(spark):
    docs = documents(spark, ["a b c d e f", "a b c d e f", "a b c d e f", None], ids=[3, None, 4, None])
    got = sorted(map(tuple, jaccard.similar_components(docs).collect()), key=str)
    assert got == [(3, 2, 3), (4, 2, 3), (None, 0, None), (None, 2, None)]
    kept = jaccard.keep_one(docs.withColumnRenamed("_id", "_keep"))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == [(3, "a b c d e f"), (None, "a b c d e f"), (None, None)]


def test_edges(spark):
    assert jaccard.similar_components(documents(spark, ["x"]).limit(0)).count() == 0
    got = jaccard.similar_components(documents(spark, ["a b c d e f", "a b c d e f", "other words"], ids=[5, 5, 2])).collect()
    assert sorted(map(tuple, got)) == [(2, 1, 2), (5, 2, 5), (5, 2, 5)]


def test_prefix_bounds():
    for n in range(3, 3000):
        assert int(jaccard.needed(n)) > jaccard.classes(4 * n // 3) and jaccard.alpha(n) >= int(jaccard.extra(n))


def test_keep_one(spark):
    texts = corpus(4)
    docs = documents(spark, texts)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in brute(texts)})


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101)], "a long, b long")
    got = dict(map(tuple, components(edges).collect()))
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_only_token_sets_travel_and_cells_come_in_parts(spark, monkeypatch):
    """no text is shuffled, and the copies of a large bundle's sets are not on disk all at once."""
    for name, value in dict(RARE=1, SMALL=2, BLOCK=2, LIST=3, SAMPLE=1, LEAST=3, COPIES=1).items():
        monkeypatch.setattr(jaccard, name, value)
    plans, stage = {}, jaccard.common.stage

    def watch(df, name):
        plans.setdefault(name, []).append(df._jdf.queryExecution().optimizedPlan().toString())
        return stage(df, name)

    monkeypatch.setattr(jaccard.common, "stage", watch)
    texts = corpus(6)
    before = jaccard.common.staged()
    assert sorted(map(tuple, jaccard.similar_components(documents(spark, texts)).collect())) == brute(texts)
    (plan,) = plans["tokens"]
    assert plan.index("Join") < plan.index("MapInArrow")  # sets are joined, made of texts where these lie
    assert len(plans["bundle-links"]) > 2
    assert not [p for p in jaccard.common.staged() - before if "bundle" in p or "wanted" in p]


def test_filter_of_ids_loses_none(spark):
    ids = [-5, 0, 3, 1 << 62, *range(1000, 3000, 7)]
    bits = jaccard._bits(spark.createDataFrame([(i,) for i in ids], "_id long"))
    assert jaccard._marked(np.array(ids), bits).all()
    assert jaccard._marked(np.arange(10**6, 10**6 + 20000), bits).mean() < 0.06
    none = jaccard._bits(spark.createDataFrame([], "_id long"))
    assert not jaccard._marked(np.array(ids), none).any()
