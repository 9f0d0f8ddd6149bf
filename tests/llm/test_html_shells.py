"""Prose survives in every shell, whatever its length; odd nesting takes linear time."""

import random
import time

import pytest

from arcweave.llm import html

SHELLS = {
    "body": "<html><body>{}</body></html>",
    "bare": "{}",
    "div": "<html><body><div>{}</div></body></html>",
    "four divs": "<body><div><div><div><div>{}</div></div></div></div></body>",
    "wrapper": '<body><div class="wrapper"><div class="row">{}</div></div></body>',
    "article": "<body><article>{}</article></body>",
    "header in article": "<body><article><header><h1>Some words of a title</h1></header>{}</article></body>",
    "main": "<body><main>{}</main></body>",
    "content": '<body><div id="content">{}</div></body>',
    "section": "<body><section>{}</section></body>",
    "cell": "<body><table><tr><td>{}</td></tr></table></body>",
    "details": "<body><article><h1>Some words of a title</h1><details><summary>Read on</summary>{}</details></article></body>",
}
NAV = '<nav><ul><li><a href="/a">Start</a></li><li><a href="/b">Contact us</a></li><li><a href="/c">More</a></li></ul></nav>'
FOOT = "<footer><p>&copy; 2024 Some owner. All rights reserved.</p></footer>"


@pytest.fixture(scope="module")
def model():
    return html.Extractor()


def paragraph(rng, sentences, words):
    one = lambda: " ".join(rng.choice(["river", "stone", "of", "the", "quiet", "morning", "they", "walked", "and", "again"]) for _ in range(words))
    return " ".join(f"{one().capitalize()}." for _ in range(sentences))


def pages(shell, around, lengths):
    rng, out = random.Random(3), []
    for n in range(1, 7):
        for sentences, words in lengths:
            paras = [paragraph(rng, sentences, words) for _ in range(n)]
            page = SHELLS[shell].format("".join(f"<p>{p}</p>" for p in paras))
            if around:
                page = page.replace("<body>", f"<body>{NAV}").replace("</body>", f"{FOOT}</body>") if "<body>" in page else NAV + page + FOOT
            out.append((page, paras))
    return out


@pytest.mark.parametrize("shell", sorted(SHELLS))
@pytest.mark.parametrize("around", ["", "nav"])
def test_prose_survives(model, shell, around):
    made = pages(shell, around, ((2, 13), (4, 12), (9, 14)))
    for got, (page, paras) in zip(model.texts([p for p, _ in made]), made):
        lines = got.split("\n")
        assert [p for p in paras if p not in lines] == [], page
        assert "Contact" not in got and "rights" not in got, page
        assert ("title" in got) == ("title" in page)


def test_very_short_prose(model):
    """Paragraphs of eight or sixteen words: a nameless div with one or two may pass for a notice, nothing else may."""
    made = [x for shell in SHELLS for around in ("", "nav") for x in pages(shell, around, ((1, 8), (2, 8)))]
    lost = [page for got, (page, paras) in zip(model.texts([p for p, _ in made]), made) if any(p not in got.split("\n") for p in paras)]
    assert len(lost) <= 0.03 * len(made)


def test_text_without_markup(model):
    rng = random.Random(4)
    texts = [paragraph(rng, n, 10) for n in (1, 2, 3, 8, 30)]
    assert model.texts(texts) == texts
    assert model.texts(["", "   \n"]) == ["", ""]
    assert model.texts([f"<article><p>{texts[3]}</p><![CDATA[ x > y ]]></article>"]) == [texts[3]]


@pytest.mark.parametrize("page", ["<div>" * 40_000 + "</section>" * 40_000, "<div>" * 40_000 + "<li>x</li>" * 40_000, "<div>" * 20_000 + "<td>x" * 20_000, "<ul><li>" * 20_000 + "</p>" * 20_000])
def test_odd_nesting_is_linear(page):
    start = time.process_time()
    html.parse(page)
    assert time.process_time() - start < 4
