import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, _text string, kind int, b int"


def documents(spark, texts, parts=3, ids=None):
    """A documents table with columns whose names clash with internal ones."""
    rows = [(i if ids is None else ids[i], t, "en", "s", None if t is None else len(t), "x", "y", 7, 9) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def near(rng, text, changes):
    w = text.split(" ")
    for _ in range(changes):
        w[rng.randrange(len(w))] = f"c{rng.randrange(10**6)}"
    return " ".join(w)


def corpus(seed=1):
    """Groups of copies, near copies, shared passages, tiny, empty and null texts."""
    rng = random.Random(seed)
    passage = prose(rng, 60)
    out = [None, "", "   \n\t ", "one", "One", "a b c d", "A B C D", "a b c d e", "a b c d e f"]
    for _ in range(12):
        out.append(prose(rng, rng.randint(5, 150)))
    base = prose(rng, 120)
    out += [base] * 8 + [near(rng, base, rng.randint(1, 6)) for _ in range(40)]
    out += [f"{prose(rng, 30)} {passage} {prose(rng, 30)}" for _ in range(25)]
    out += [passage + " " + prose(rng, 4) for _ in range(20)]
    short = prose(rng, 9)
    out += [short + " " + prose(rng, 1) for _ in range(12)]
    out.append(prose(rng, 4000))
    out.append(out[-1] + " " + prose(rng, 300))
    return out
