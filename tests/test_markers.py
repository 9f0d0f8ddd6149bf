import random
import re

import duckdb
import pytest

from arcweave.operators import markers
from arcweave.operators.claims import OVERRIDES, PROFILE


def by_regex(sentence):
    out = []
    for name, heads, tails in markers.BANKS:
        bank = lambda p: r"\b(?:" + "|".join(map(re.escape, p)) + r")\b"
        if re.search(bank(heads) + (".*" + bank(tails) if tails else ""), sentence, re.A):
            out.append(name)
    return out


def sentences(seed, n):
    rng = random.Random(seed)
    words = sorted({w for _, a, b in markers.BANKS for p in (*a, *b) for w in p.split()}) + "the you seen bodyguard noöne it's über _i i_ so, (me) a".split()
    return [rng.choice(["", " ", "é"]).join([" ".join(rng.choices(words, k=rng.randint(0, 14)))]) for _ in range(n)]


def test_automaton_against_regular_expressions():
    for s in sentences(1, 4000):
        assert markers.fired(s, markers.BANKS) == by_regex(s), s


def test_own_phrases_and_bounds(spark, monkeypatch):
    banks = (("greeting", ("good day", "hello"), ()), ("order", ("before",), ("after",)))
    assert markers.fired("hello, before and after", banks) == ["greeting", "order"]
    assert markers.fired("after, before; othello", banks) == [] == markers.fired("x", ())
    df = spark.createDataFrame([(1, None, "m"), (2, "", "m"), (3, "Hello.\n\n Good day! ?x", "m"), (3, "Hello", "m")], "id long, text string, marks string")
    got = sorted((r.id, r.sentence, r.marks) for r in markers.marked(df, ["id"], banks=banks).collect())
    assert got == [(3, 1, ["greeting"]), (3, 1, ["greeting"]), (3, 2, ["greeting"]), (3, 3, [])]
    monkeypatch.setattr(markers, "MOST_CHARS", 3)
    with pytest.raises(ValueError):
        markers.marked(df, ["id"], banks=banks)


def test_verdicts_against_sql(spark):
    said = sentences(2, 300) + ["I see your face in the photo", "I cannot see any picture", "I don't hear a voice", "My weights do not update from you", "I am not a neural network. I read text", "The sky is blue"]
    rows = [(i // 3, i % 3, s + (". " if i % 2 else "\n") + said[-1 - i % 9]) for i, s in enumerate(said)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    profile = {**PROFILE, **OVERRIDES}
    got = markers.judged(markers.marked(df, ["conv_id", "turn"]), profile)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?)", rows)
    out = con.execute(markers.oracle(profile))
    names = [c[0] for c in out.description]
    want = sorted((tuple(r[names.index(c)] for c in got.columns) for r in out.fetchall()), key=str)
    assert sorted(map(tuple, got.collect()), key=str) == want and len({w[5] for w in want}) >= 4
