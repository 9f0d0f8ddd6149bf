import hashlib
import random
import re

import pytest

from arcweave.llm import leaks

from .helpers import documents, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, size=10):
    wins = {}
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - size + 1, 1) if w else 0):
            wins.setdefault(tuple(w[i : i + size]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, ids = words(text), set(), set()
        for k in {len(x) for x in wins}:
            for i in range(len(w) - k + 1):
                if (x := tuple(w[i : i + k])) in wins:
                    hit |= set(range(i, i + k))
                    ids |= wins[x] - {None}
        listed = ",".join(sorted(map(str, ids)))
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def cases(seed=3):
    rng = random.Random(seed)
    items = [(i, prose(rng, rng.randint(10, 40), 30)) for i in range(12)]
    items += [(3, "Zwei Wörter"), (100, "solo"), (101, "Three tiny words"), (20, None), (21, ""), (22, " .,! "), (None, prose(rng, 12, 30)), (23, items[0][1]), (24, items[0][1] + " more")]
    docs = [None, "", "...", "SOLO", "a solo, b", "zwei-wörter", "Zwei WÖRTER", "three Tiny words", "three tiny"]
    for _ in range(30):
        w = prose(rng, rng.randint(0, 60), 30).split(" ")
        x = rng.choice(items)[1] or ""
        cut = x.split(" ")[rng.randint(0, 3) : rng.randint(8, 50)]
        docs.append(" ".join(w[: len(w) // 2]) + "\n" + rng.choice([" ", ", "]).join(cut).upper() + " " + " ".join(w[len(w) // 2 :]))
    docs += [items[0][1]] * 6 + [prose(rng, 3000, 30) + " " + items[5][1] * 1]
    return docs, items


def run(spark, docs, items, ids=None, **how):
    bench = spark.createDataFrame([(a, b, 1, "x") for a, b in items], "item_id long, text string, w int, own string").repartition(2)
    return sorted(map(tuple, leaks.leaks(documents(spark, docs, ids=ids), bench, **how).collect()), key=str)


def test_against_brute_force(spark):
    docs, items = cases()
    ids = [i // 2 if i % 5 else None for i in range(len(docs))]  # shared and null ids
    assert run(spark, docs, items, ids) == brute(list(zip(ids, docs)), items)
    again = docs[-7:] * 2
    assert run(spark, again, items, [7] * len(again)) == brute([(7, d) for d in again], items)  # repeated rows


@pytest.mark.parametrize("size", [1, 2, 4])
def test_other_sizes(spark, size):
    docs, items = cases(size)
    docs = docs[:30]
    assert run(spark, docs, items, size=size) == brute(list(enumerate(docs)), items, size)


def test_blocks_change_nothing(spark, monkeypatch):
    docs, items = cases(9)
    want = run(spark, docs, items)
    monkeypatch.setattr(leaks, "BLOCK_BYTES", 6000)
    assert run(spark, docs, items) == want == brute(list(enumerate(docs)), items)


def test_empty_tables(spark):
    docs, items = cases()
    assert run(spark, [], items) == []
    assert run(spark, docs[:12], []) == brute(list(enumerate(docs[:12])), [])
