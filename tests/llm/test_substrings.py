import hashlib
import random

import pytest

from arcweave.llm import substrings

from .helpers import corpus, documents, near, prose


def brute(texts, k=20):
    w = [(t or "").split() for t in texts]
    first = {}
    for d, x in enumerate(w):
        for i in range(len(x) - k + 1):
            first.setdefault(tuple(x[i : i + k]), (d, i))
    out = []
    for d, x in enumerate(w):
        gone = set()
        for i in range(len(x) - k + 1):
            if first[tuple(x[i : i + k])] != (d, i):
                gone |= set(range(i, i + k))
        kept = " ".join(t for i, t in enumerate(x) if i not in gone)
        out.append((d, len(x), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def texts(seed):
    rng = random.Random(seed)
    out = corpus(seed)
    few = [prose(rng, rng.randint(1, 90), words=3) for _ in range(25)]  # branching and loops
    return out + few + ["a " * 100, "a b " * 60, "x " + "a " * 50, near(rng, out[-1], 5)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, seed):
    t = texts(seed)
    assert sorted(map(tuple, substrings.repeated_words(documents(spark, t)).collect())) == brute(t)


def test_hot_keys_and_borders_change_nothing(spark, monkeypatch):
    """Every repeated gram and window hot, source documents in blocks of seven words."""
    for name, value in dict(SPLIT=7, SAMPLE=1, LEAST=2, SPREAD=3).items():
        monkeypatch.setattr(substrings, name, value)
    t = texts(5)
    docs = documents(spark, t)
    assert all(len(x) > 50 for x in substrings.hot_keys(substrings.common.texts(docs, "doc_id", "text")))
    assert sorted(map(tuple, substrings.repeated_words(docs).collect())) == brute(t)


def test_other_rows_of_an_id_keep_their_words(spark):
    rng = random.Random(7)
    p, q = prose(rng, 40), prose(rng, 45)
    docs = documents(spark, [p, "own " + p, q, p, None], ids=[1, 2, 2, None, 3]).withColumnsRenamed({"_id": "_places", "_text": "_of", "kind": "s0"})
    out = substrings.without_repeats(docs)
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(1, p), (2, "own "), (2, q), (None, p), (3, None)], key=str)


def test_cut_keeps_the_rest(spark):
    rng = random.Random(9)
    p = prose(rng, 40)
    docs = documents(spark, [f"start\n{p}\nend", f"other\n\n{p}\nlast line", None, ""])
    got = {r.doc_id: r for r in substrings.without_repeats(docs).collect()}
    assert substrings.without_repeats(docs).columns == docs.columns
    assert got[0].text == f"start\n{p}\nend" and got[1].text == "other\n\nlast line" and got[1].n_chars == len("other\n\nlast line")
    assert got[2].text is None and got[3].text == ""


def test_edges(spark):
    assert substrings.repeated_words(documents(spark, ["x"]).limit(0)).count() == 0
    p = prose(random.Random(1), 30)
    got = sorted((r.doc_id, r.n_removed) for r in substrings.repeated_words(documents(spark, [p, p, p], ids=[1, 2, 2])).collect())
    assert got == [(1, 0), (2, 30), (2, 30)]
