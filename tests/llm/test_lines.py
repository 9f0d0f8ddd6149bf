import pytest

from arcweave.llm import lines

from .helpers import documents


def table(n=14):
    out = [f"own words of {'abcdefghijklmnop'[i]} alone\nUser u{i} logged in from host{i * 7}\n\nAll rights reserved." for i in range(n)]
    return out + ["All rights reserved.", None, "", "\n\n", "own words of z alone"]


def test_templates_are_dropped_but_for_the_first(spark):
    got = {r.doc_id: r for r in lines.line_query(documents(spark, table())).collect()}
    assert got[0].text.split("\n") == table()[0].split("\n") and got[0].n_dropped == 0
    for i in range(1, 14):
        assert "All rights" not in got[i].text and "logged in" not in got[i].text and got[i].n_dropped >= 2
    assert got[14].text == "" and got[15].text == "" and got[16].text == "" and got[17].text == "\n\n" and got[17].n_dropped == 0


def test_copies_count_once(spark):
    text = "a line of its own here\nanother line that is long"
    got = lines.line_query(documents(spark, [text] * 30)).collect()
    assert all(r.n_dropped == 0 and r.text == text for r in got)


@pytest.mark.parametrize("leaf", [512, 3])
def test_a_text_counts_once_per_template(spark, monkeypatch, leaf):
    monkeypatch.setattr(lines, "LEAF", leaf)
    w = "amber birch cedar dogwood elm fir gum hazel iris juniper kauri larch".split()
    one = "\n".join(f"the door of {x} was shut at the end of day" for x in w)
    got = lines.line_query(documents(spark, [one] * 12 + ["something else", one + "\nmore"])).collect()
    assert all(r.n_dropped == 0 for r in got)
    spread = [one] + [f"the door of {x} was shut at the end of day\nown {x}" for x in w[:9]]
    got = [r.n_dropped for r in sorted(lines.line_query(documents(spark, spread)).collect())]
    assert got == [11] + [1] * 9


def test_word_fields_generalise_and_crowded_leaves_agree(spark, monkeypatch):
    t = [f"the door of {w} was shut at the end of day\nx{w}" for w in "amber birch cedar dogwood elm fir gum hazel iris juniper kauri larch".split()]
    want = [0] + [1] * 11
    small = [r.n_dropped for r in sorted(lines.line_query(documents(spark, t)).collect())]
    monkeypatch.setattr(lines, "LEAF", 3)
    crowded = [r.n_dropped for r in sorted(lines.line_query(documents(spark, t)).collect())]
    assert small == want and crowded == want


def test_leaves_of_any_size_give_the_same_templates(spark, monkeypatch):
    w = "amber birch cedar dogwood elm fir gum hazel iris juniper kauri larch".split()
    t = [f"the door of {x} was shut at the end of day\nx{x}" for x in w]
    t += [f"the door of gold {x} opens only when rain comes down\ny{x}" for x in w]
    t += [f"the door of some {x} that {a} {x}{a} had {x}s {a}r before" for x, a in zip(w, reversed(w))]
    want = [0] + [1] * 11 + [0] + [1] * 11 + [0] * 12
    for leaf in (512, 16, 5, 1):
        monkeypatch.setattr(lines, "LEAF", leaf)
        assert [r.n_dropped for r in sorted(lines.line_query(documents(spark, t)).collect())] == want


def test_lines_that_share_only_their_start_or_numbers_stay(spark):
    w = "amber birch cedar dogwood elm fir gum hazel iris juniper kauri larch".split()
    t = [f"there was a {x}\nthere was a {x} there\nin the end 1{i} | {x} | 5 {x}{x}\n{i} 2{i} 3{i} 4{i}\n| 7{i} | 8{i} |\ntotal of {i} 2{i} items" for i, x in enumerate(w)]
    got = sorted(lines.line_query(documents(spark, t)).collect())
    assert [r.n_dropped for r in got] == [0] + [1] * 11
    assert [r.text.split("\n") for r in got[1:]] == [x.split("\n")[:5] for x in t[1:]]


def test_stage_keeps_rows_and_columns(spark):
    docs = documents(spark, table())
    out = lines.without_recurring(docs)
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns == docs.columns and len(got) == docs.count() and got[15].text is None
    assert got[3].n_chars == len(got[3].text) and "All rights" not in got[3].text


def test_edges(spark):
    assert lines.line_query(documents(spark, ["x"]).limit(0)).count() == 0
    assert lines.mask(b"a 1b c\x0b2") == [b"a", b"<*>", b"c", b"<*>"]


@pytest.mark.parametrize("docs,dropped", [(9, 0), (10, 9)])
def test_threshold(spark, docs, dropped):
    t = [f"same words in all\nown {'abcdefghij'[i]}" for i in range(docs)]
    assert sum(r.n_dropped for r in lines.line_query(documents(spark, t)).collect()) == dropped


def brute(texts, min_docs=10, depth=3, similar=0.6):
    """The template tree as one loop over all lines of distinct texts, one template at a time."""
    import math
    import re

    def fields(line):
        return ["<*>" if re.search("[0-9]", t) else t for t in re.split(r"[\x20\x09-\x0D]+", line) if t]

    def fixed(t):
        return t != "<*>" and re.search(r"[A-Za-z\x80-￿]", t)

    def agree(a, b):
        rest = list(zip(a[depth:], b[depth:]))
        return sum(x == y and bool(fixed(x)) for x, y in rest) >= math.ceil(similar * len(rest) - 1e-9)

    docs, place = {}, {}
    for i, t in enumerate(texts):
        for k, line in enumerate((t or "").split("\n")):
            f = tuple(fields(line))
            if f and ("<*>" not in f or any(map(fixed, f))):
                docs.setdefault(f, set()).add(t)
                place.setdefault(f, []).append((i, k))
    leaves = {}
    for f in docs:
        leaves.setdefault((len(f), f[:depth]), []).append(f)
    gone = set()
    for rows in leaves.values():
        rows.sort(key=lambda f: (-len(docs[f]), lines._long(" ".join(f).encode())))
        leads, of = [], {}

        def may(f):
            need = math.ceil(similar * len(f[depth:]) - 1e-9)
            return sum(min(min_docs, sum(len(docs[g]) for g in rows if g[p] == f[p])) for p in range(depth, len(f)) if fixed(f[p])) >= need * min_docs

        for f in rows:
            if may(f) and not any(agree(f, lead) for lead in leads):
                leads.append(f)
        for f in rows:
            of[f] = next((lead for lead in leads if agree(f, lead)), f)
        for lead in set(of.values()):
            own = [f for f in rows if of[f] == lead]
            if len(set().union(*(docs[f] for f in own))) >= min_docs:
                gone |= set(sorted(p for f in own for p in place[f])[1:])
    return ["\n".join(x for k, x in enumerate((t or "").split("\n")) if (i, k) not in gone) for i, t in enumerate(texts)]


@pytest.mark.parametrize("leaf", [512, 3])
def test_equals_brute_force(spark, monkeypatch, leaf):
    import random

    monkeypatch.setattr(lines, "LEAF", leaf)
    rng = random.Random(4)
    kinds = ["all rights are reserved by {a} and {b} for now", "posted on {n} by {a}", "the {a} of {b} was shut", "{a}", "read more about {a} {b} here | {n}", "- {n}, {n}"]
    one = lambda: rng.choice(kinds).format(a=rng.choice("ash bay cedar elm fir".split()), b=rng.choice("gum hazel iris".split()), n=rng.randrange(99))
    texts = ["\n".join([*(one() for _ in range(rng.randint(0, 6))), f"own line {'abcdefgh'[i % 8]}{'abcdefgh'[i // 8]} of text"]) for i in range(60)]
    texts += [texts[3], texts[3], None, ""]
    got = [r.text for r in sorted(lines.line_query(documents(spark, texts)).collect())]
    assert got == brute(texts) and got != texts


def test_other_rows_of_an_id_keep_their_lines(spark):
    t = [f"All rights reserved.\nown {w}" for w in "amber birch cedar dogwood elm fir gum hazel iris juniper kauri larch".split()]
    docs = documents(spark, [*t, "precious unique content\nmore of it", "no id\nAll rights reserved."], ids=[*range(12), 5, None])
    got = {(r.doc_id, r.text) for r in lines.line_query(docs).collect()}
    assert (5, "precious unique content\nmore of it") in got and (5, "own fir") in got and (None, "no id\nAll rights reserved.") in got
    assert {(r.doc_id, r.text) for r in lines.without_recurring(docs).collect()} == got


def test_names_of_other_columns_do_not_clash(spark):
    docs = documents(spark, table()).withColumnsRenamed({"_id": "_gone", "_text": "gone", "kind": "doc", "b": "_of"})
    out = lines.without_recurring(docs)
    assert out.columns == docs.columns and {(r._gone, r.gone, r.doc) for r in out.collect()} == {("x", "y", 7)}
    assert {r.n_dropped for r in lines.line_query(docs).collect()} != {0}
