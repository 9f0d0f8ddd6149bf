import random
import time
from html.parser import HTMLParser

import pytest

from arcweave.llm import html


def texts(page):
    return " ".join(t for _, t in html.parse(page)[1])


@pytest.mark.parametrize("tag", "button select object svg math audio video canvas template datalist noscript".split())
def test_unclosed_elements_do_not_end_the_page(tag):
    assert "later words" in texts(f"<p>first</p><{tag}><{tag}><p>later words</p>")
    assert texts(f"<p>first</p><{tag}>inner</{tag.upper()}><p>later words</p>") == "first later words"
    assert texts(f"<p>first</p><{tag}>a<{tag}>b</{tag}>c</{tag}><p>later words</p>") == "first later words"


@pytest.mark.parametrize("tag", "script style textarea title iframe".split())
def test_raw_text(tag):
    assert texts(f"<p>first</p><{tag}><p>later</p>") == "first"
    assert texts(f"<p>first</p><{tag}>a</{tag}y> b <p></{tag.upper()} ><p>later</p>") == "first later"


def test_offsets_hold_on_turkish_pages():
    assert texts("<p>" + "İ" * 40 + "</p><script>x</script><p>later words</p>") == "İ" * 40 + " later words"


def test_quotes():
    assert texts('<p title="foo>one</p><p class="x">two</p>') == "one two"
    assert texts("<p title='foo>one</p><p>two</p>") == "one two"
    assert texts('<p title="a > b <i>">one</p><p title=don\'t>two</p>') == "one two"


def test_inline_elements_do_not_split_words():
    assert texts("<p>ro<script>x()</script>se and th<b>or</b>n<svg><g/></svg>s</p>") == "rose and thorns"
    assert texts("<p>a<br>b<!-- c -->d</p>") == "a bd"


@pytest.mark.parametrize("page", ['<p title="foo>x' * 40_000, "<object>" * 80_000, "<p>" * 40_000, "<" * 400_000, "<script>" * 50_000, "<!-- " * 80_000, "<a href='" * 50_000])
def test_odd_pages_take_linear_time(page):
    start = time.perf_counter()
    html._visible(html._tokens(page))
    assert time.perf_counter() - start < 5


class Plain(HTMLParser):
    """Text between block borders, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.own, self.off = [], [], 0

    def border(self):
        t = " ".join("".join(self.own).split())
        self.out += [t] if t else []
        self.own = []

    def handle_starttag(self, tag, attrs):
        if tag in html.RAW | html.SKIP:
            self.off += 1
        elif tag in html.BLOCK or tag == "hr":
            self.border()
        elif tag == "br":
            self.own.append(" ")

    def handle_endtag(self, tag):
        if tag in html.RAW | html.SKIP:
            self.off -= 1
        elif tag in html.BLOCK:
            self.border()

    def handle_data(self, data):
        if not self.off:
            self.own.append(data)


def drawn(rng):
    """A page by a generator that shares nothing with the one the model learns from, and its main text."""
    w = lambda n: " ".join(rng.choice("harbour winter signal copper lantern meadow engine violet paper stone market river".split()) for _ in range(n))
    say = lambda: f"{w(rng.randint(6, 14)).capitalize()}, {w(rng.randint(3, 9))}. {w(rng.randint(5, 12)).capitalize()}."
    main, body = [], []
    title = w(rng.randint(3, 7)).title()
    main.append(title)
    body.append(f"<h1 class='headline'>{title}</h1>")
    for _ in range(rng.randint(2, 9)):
        k = rng.random()
        if k < 0.6:
            t = say()
            main.append(t)
            body.append(f"<p>{t.replace(',', ',<em></em>')}</p>")
        elif k < 0.75:
            t = w(4).title()
            main.append(t)
            body.append(f"<h2>{t}</h2>")
        elif k < 0.9:
            items = [say() for _ in range(3)]
            main += items
            body.append("<ol>" + "".join(f"<li>{x}" for x in items) + "</ol>")
        else:
            body.append(f"<div class='advert'><p>{say()}</p></div>")
    links = lambda n: "".join(f'<li><a href="/{i}">{w(2)}</a></li>' for i in range(n))
    top = rng.choice([f"<header id='top'><a href='/'>{w(2)}</a><nav><ul>{links(5)}</ul></nav></header>", f"<nav class='menu'><ul>{links(6)}</ul></nav>"])
    end = rng.choice([f"<aside class='sidebar'><h3>{w(2)}</h3><ul>{links(4)}</ul></aside>", f"<div class='comments'><div class='comment'><p>{say()}</p></div><div class='comment'><p>{say()}</p></div></div>", ""])
    foot = f"<footer><p>&copy; 2021 {w(3)}</p></footer><script>var x = '<p>no</p>';</script>"
    shell = rng.choice(["article", "main", "div class='article-content'", "div id='content'"])
    return f"<!doctype html><html><head><title>{w(3)}</title></head><body>{top}<{shell}>{''.join(body)}</{shell.split()[0]}>{end}{foot}</body></html>", main


def test_parser_agrees_with_the_standard_library():
    rng = random.Random(8)
    for _ in range(60):
        page, _ = drawn(rng)
        p = Plain()
        p.feed(page)
        p.close()
        p.border()
        assert [t for _, t in html.parse(page)[1]] == p.out


def test_pages_of_another_generator():
    rng = random.Random(9)
    model = html.Extractor()
    pages = [drawn(rng) for _ in range(80)]
    got = model.texts([p for p, _ in pages])
    right = wrong = missed = 0
    for text, (_, main) in zip(got, pages):
        own = text.split("\n") if text else []
        right += len(set(own) & set(main))
        wrong += len(set(own) - set(main))
        missed += len(set(main) - set(own))
    assert right / (right + wrong) > 0.95 and right / (right + missed) > 0.95, (right, wrong, missed)
