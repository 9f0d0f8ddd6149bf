"""Main-text extraction with a tree-structured graphical model over the DOM.

A page's block elements are the nodes of a tree; each is content or not. A
node's own evidence (tag, class and id words, text length, link share,
punctuation, depth, what encloses it) gives a unary potential and each
parent-child edge a pairwise one, by the kind of the child's tag. Messages
pass once up and once down the tree, exactly (sum-product), and every block
whose content marginal is one half or more is kept. The weights maximise the
likelihood of labelled pages, by the difference of observed and expected
features; :func:`labelled_pages` draws such pages from many layouts, with the
label of each element in an attribute that the extractor never sees.

Defined cases: null and empty pages give an empty text; broken markup is
closed by the rules of its tags; an unfinished tag or comment at the end is no
text; a quote left open ends with its tag; white space (also no-break and other
Unicode spaces) in a block becomes one space; blocks are joined in page order; a
block whose marginal is exactly one half is kept; text without markup is one
block, the root; pages of any length are read whole, in linear time; each row is done
by itself, so rows that share an id, and repeated rows, each get their own text; null ids
stay null, an empty table gives no rows, and other columns are not read.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Raw text: nothing inside is markup but the end tag; without one, these hold the rest of the page.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements whose inside is no text; they nest, and without an end tag only the tag itself goes.
SKIP = frozenset("noscript svg math template select button object audio video canvas datalist".split())
BLOCK = frozenset("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption header footer nav aside form fieldset address details summary center menu dialog legend label hgroup search".split())
CLOSES_P = BLOCK - {"label", "legend", "td", "th", "tr", "caption", "html", "body"}
#: What an opening tag ends when it is open, up to the nearest of the fences.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}), "thead": ({"caption"}, {"table"}), "tfoot": ({"tr", "td", "th", "tbody"}, {"table"})}
KINDS = {"p": 1, "pre": 1, "blockquote": 1, "h1": 2, "h2": 2, "h3": 2, "h4": 2, "h5": 2, "h6": 2, "ul": 3, "ol": 3, "li": 3, "dl": 3, "dt": 3, "dd": 3, "menu": 3, "header": 4, "footer": 4, "nav": 4, "aside": 4, "form": 4, "dialog": 4, "address": 4, "main": 5, "article": 5, "section": 6, "div": 6, "figure": 6, "table": 6}
N_KINDS = 7

_MARK = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
_TAG = re.compile(r"[^\s/>]+")
_INSIDE = re.compile(r">|=\s*([\"'])")
_RAW_END = {t: re.compile(f"</{t}(?=[\\s/>])", re.I | re.A) for t in RAW}
_ATTR = re.compile(r"(?:^|\s)(class|id|role|data-y)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAME = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("tag", "names", "parent", "depth", "text", "linked", "label", "order", "under")

    def __init__(self, tag, names, parent, label=None):
        self.tag, self.names, self.parent, self.label = tag, names, parent, label
        self.depth = parent.depth + 1 if parent else 0
        self.text: list[str] = []
        self.linked = 0


@lru_cache(maxsize=4096)
def _names(attrs: str) -> tuple[tuple[str, ...], str | None]:
    names, label = [], None
    for m in _ATTR.finditer(attrs):
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() == "data-y":
            label = value
        else:
            names += _NAME.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())
    return tuple(dict.fromkeys(names)), label


def _tag_end(html: str, at: int) -> int:
    """The place behind a tag's ``>``, or -1; ``at`` is behind its name.

    A quoted value holds whatever stands up to the next quote of its kind. If
    there is none, or it opens another value (``=`` before it), the quote was
    left open and the tag ends at the next ``>``.
    """
    while True:
        m = _INSIDE.search(html, at)
        if m is None:
            return -1
        if m[1] is None:
            return m.end()
        close = html.find(m[1], m.end())
        if close < 0 or close > m.end() and html[close - 1] == "=":
            return html.find(">", m.end()) + 1 or -1
        at = close + 1


def _tokens(html: str) -> list[tuple[str, str, str]]:
    """(kind, tag, body) in page order: text, open and close; comments and raw text are left out."""
    out: list[tuple[str, str, str]] = []
    at, n = 0, len(html)
    while at < n:
        m = _MARK.search(html, at)
        if m is None:
            out.append(("text", "", html[at:]))
            break
        if m.start() > at:
            out.append(("text", "", html[at : m.start()]))
        if m[0][1] in "!?":
            data = html.startswith("[CDATA[", m.end())
            end = html.find("-->", m.end()) + 3 if m[0] == "<!--" else html.find("]]>", m.end()) + 3 if data else html.find(">", m.end()) + 1
            at = end if end > m.end() - 1 and end > 2 else n
            continue
        name = _TAG.match(html, m.end() - 1)
        end = _tag_end(html, name.end())
        if end < 0:
            break  # an unfinished tag ends the page
        tag, at = name[0].lower(), end
        if m[0][1] == "/":
            out.append(("close", tag, ""))
            continue
        attrs = html[name.end() : end - 1]
        if tag not in RAW:
            out.append(("open", tag, attrs))
        elif not attrs.endswith("/") or tag in ("script", "style"):
            close = _RAW_END[tag].search(html, at)
            if close is None:
                break
            at = html.find(">", close.end()) + 1 or n
    return out


def _visible(tokens: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    """The tokens without skipped elements: each open tag is matched with the end tag that nests with it."""
    ends: dict[int, int] = {}
    stacks: dict[str, list[int]] = {}
    for k, (kind, tag, body) in enumerate(tokens):
        if tag in SKIP:
            if kind == "open" and not body.endswith("/"):
                stacks.setdefault(tag, []).append(k)
            elif kind == "close" and stacks.get(tag):
                ends[stacks[tag].pop()] = k
    if not ends:
        return tokens
    out, k = [], 0
    while k < len(tokens):
        if k in ends:
            k = ends[k]
        else:
            out.append(tokens[k])
        k += 1
    return out


def parse(html: str) -> tuple[list[Node], list[tuple[Node, str]]]:
    """Block nodes in page order (the root first) and the (node, text) runs between block borders."""
    root = Node("html", (), None)
    nodes, stack = [root], [root]  # open blocks only; inline tags do not nest blocks
    opened: dict[str, int] = {}  # how many of a tag are on the stack, so that none is looked for in vain
    runs: list[tuple[Node, str]] = []
    buffer: list[str] = []
    links = 0

    def border():
        if buffer:
            text = " ".join(unescape("".join(buffer)).split())
            if text:
                runs.append((stack[-1], text))
                stack[-1].text.append(text)
            buffer.clear()

    def leave(k):
        for v in stack[k:]:
            opened[v.tag] -= 1
        del stack[k:]

    for kind, tag, body in _visible(_tokens(html)):
        if kind == "text":
            buffer.append(body)
            if links:
                stack[-1].linked += len(body)
        elif kind == "close":
            if tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCK:
                border()
                links = 0
                for k in range(len(stack) - 1, 0, -1) if opened.get(tag) else ():
                    if stack[k].tag == tag:
                        leave(k)
                        break
                    if tag in ("p", "li") and stack[k].tag in ("article", "section", "main", "body", "table", "div", "td"):
                        break
        elif tag == "br":
            buffer.append(" ")
        elif tag == "hr":
            border()
        elif tag in VOID or tag in SKIP or body.endswith("/") and tag not in BLOCK:
            pass
        elif tag == "a":
            links += 1
        elif tag in BLOCK:
            border()
            if tag in ("html", "body") and len(stack) == 1:
                root.label = _names(body)[1] or root.label
                continue
            links = 0
            if tag in CLOSES_P:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == "p" or (tag[0] == "h" and tag[1:].isdigit() and stack[k].tag[0] == "h" and stack[k].tag[1:].isdigit()):
                        leave(k)
                        break
                    if stack[k].tag in BLOCK:
                        break
            if tag in IMPLIED:
                ends, fence = IMPLIED[tag]
                cut, left, k = None, sum(opened.get(t, 0) for t in ends), len(stack) - 1
                while left and stack[k].tag not in fence:
                    if stack[k].tag in ends:
                        cut, left = k, left - 1
                    k -= 1
                if cut:
                    leave(cut)
            names, label = _names(body)
            node = Node(tag, names, stack[-1], label)
            nodes.append(node)
            stack.append(node)
            opened[tag] = opened.get(tag, 0) + 1
    border()
    return nodes, runs


def _bucket(n: int) -> int:
    return min(7, n.bit_length() // 2) if n else 0


def _features(nodes: list[Node]) -> list[list[str]]:
    out = []
    bare = not any(v.tag in ("article", "main") for v in nodes)
    for v in nodes:
        v.under = sum(map(len, v.text))
    for v in nodes[:0:-1]:  # children stand behind their parents
        v.parent.under += v.under
    whole = max(1, nodes[0].under)
    for v in nodes:
        text = " ".join(v.text)
        f = ["bias", f"t:{v.tag}", f"len:{_bucket(len(text))}", f"share:{min(4, 5 * v.under // whole)}"]
        if bare:
            f.append(f"bare:{v.tag}<{v.parent.tag}" if v.parent else "bare")
        f += [f"c:{x}" for x in v.names]
        if text:
            f.append(f"link:{min(4, 5 * v.linked // max(1, len(text)))}")
            f.append("stop:" + str(min(3, sum(text.count(c) for c in ".!?,"))))
            if v.tag == "p":
                f.append(f"p-len:{_bucket(len(text))}")
        if v.parent is not None:
            f += [f"up:{v.parent.tag}", f"up-share:{min(4, 5 * v.parent.under // whole)}"]
            f += [f"uc:{x}" for x in v.parent.names]
            f.append(f"t-up:{v.tag}<{v.parent.tag}")
        out.append(f)
    return out


class Forest:
    """Many trees as flat arrays, in level order, so that a message round is one numpy step."""

    def __init__(self, trees: list[list[Node]], index: dict[str, int], grow: bool = False):
        parent, depth, kind, label, rows, cols = [], [], [], [], [], []
        for nodes in trees:
            base = len(parent)
            for k, v in enumerate(nodes):
                v.order = base + k
            for v, feats in zip(nodes, _features(nodes)):
                parent.append(v.parent.order if v.parent else -1)
                depth.append(v.depth)
                kind.append(KINDS.get(v.tag, 0))
                label.append(v.label == "1")
                for f in feats:
                    i = index.setdefault(f, len(index)) if grow else index.get(f, -1)
                    if i >= 0:
                        rows.append(v.order)
                        cols.append(i)
        self.n = len(parent)
        self.parent, self.kind, self.label = np.array(parent, np.int64), np.array(kind, np.int64), np.array(label, bool)
        self.rows, self.cols = np.array(rows, np.int64), np.array(cols, np.int64)
        depth = np.array(depth, np.int64)
        by = np.argsort(depth, kind="stable")
        self.levels = np.split(by, np.flatnonzero(np.diff(depth[by])) + 1) if self.n else []

    def marginals(self, w: np.ndarray, pair: np.ndarray):
        """P(content) of each node and the joint of each (parent, child) edge."""
        unary = np.zeros((self.n, 2))
        unary[:, 1] = np.bincount(self.rows, w[self.cols], minlength=self.n)
        up = unary.copy()  # log belief of the subtree
        message = np.zeros((self.n, 2))  # from a child, by the parent's label
        for level in self.levels[:0:-1]:
            m = np.logaddexp(up[level, 0, None] + pair[self.kind[level], :, 0], up[level, 1, None] + pair[self.kind[level], :, 1])
            message[level] = m
            np.add.at(up, self.parent[level], m)
        belief = up.copy()
        joint = np.zeros((self.n, 2, 2))
        for level in self.levels[1:]:
            above = belief[self.parent[level]] - message[level]  # the parent without this child
            t = above[:, :, None] + pair[self.kind[level]] + up[level][:, None, :]
            t -= t.max(axis=(1, 2), keepdims=True)
            e = np.exp(t)
            e /= e.sum(axis=(1, 2), keepdims=True)
            joint[level] = e
            belief[level] = np.logaddexp(above[:, 0, None] + pair[self.kind[level], 0, :], above[:, 1, None] + pair[self.kind[level], 1, :]) + up[level]
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -60, 60))), joint


def fit(forest: Forest, width: int, steps: int = 250, rate: float = 0.1, ridge: float = 1e-3):
    """Weights that make the labels likely: observed less expected features, by Adam."""
    size = width + N_KINDS * 4
    theta, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    y = forest.label.astype(float)
    child = np.flatnonzero(forest.parent >= 0)
    seen = np.zeros((N_KINDS, 2, 2))
    np.add.at(seen, (forest.kind[child], y[forest.parent[child]].astype(int), y[child].astype(int)), 1)
    for t in range(1, steps + 1):
        p, joint = forest.marginals(theta[:width], theta[width:].reshape(N_KINDS, 2, 2))
        g_w = np.bincount(forest.cols, (p - y)[forest.rows], minlength=width)
        g_p = -seen.copy()
        np.add.at(g_p, forest.kind[child], joint[child])
        g = np.r_[g_w, g_p.ravel()] / forest.n + ridge * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return theta[:width], theta[width:].reshape(N_KINDS, 2, 2)


def labelled_pages(n: int = 640, seed: int = 7) -> list[str]:
    """Pages of many layouts; ``data-y="1"`` marks the elements whose own text is content."""
    rng = random.Random(seed)
    rough = False
    syllables = "ka lo mi ter an sho pri vel un do ra se".split()

    def words(a, b):
        return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(rng.randint(a, b)))

    def prose(a=8, b=70):
        if rough:  # lists, verse, repeated words: text without sentences
            return " ".join(rng.choice([[words(2, 6)] * rng.randint(1, 9), [words(a, b)]]))
        return ". ".join(words(5, 14).capitalize() for _ in range(max(1, rng.randint(a, b) // 10))) + "."

    def menu(k):
        items = "".join(f'<li data-y="0"><a href="/{words(1, 1)}">{words(1, 3)}</a></li>' for _ in range(k))
        return f'<ul data-y="0" class="{rng.choice(["menu", "nav-list", "links", "", "list"])}">{items}</ul>'

    def block(tag, cls, inner, y=0):
        kind = rng.choice(["class", "class", "id"])
        return f'<{tag} {kind}="{cls}" data-y="{y}">{inner}</{tag}>' if cls else f'<{tag} data-y="{y}">{inner}</{tag}>'

    def body():
        out = [f'<h{rng.choice([1, 1, 1, 2])} data-y="1">{words(2, 9)}</h1>'] if rng.random() < 0.9 else []
        for _ in range(rng.choice([0, 1, 2, 3, 5, 9, 14, 40])):
            r = rng.random()
            if r < 0.54:
                out.append(f'<p data-y="1">{prose()}</p>')
            elif r < 0.64:
                out.append(f'<p data-y="1"><b>{prose(4, 30)}<br>')
            elif r < 0.69:
                out.append(f'<p data-y="1">{words(1, 6)}.</p>')
            elif r < 0.74:
                out.append(f'<h{rng.randint(2, 4)} data-y="1">{words(2, 6)}</h2>')
            elif r < 0.79:
                out.append('<ul data-y="1">' + "".join(f'<li data-y="1">{prose(5, 20)}</li>' for _ in range(rng.randint(2, 5))) + "</ul>")
            elif r < 0.82:
                out.append(f'<blockquote data-y="1"><p data-y="1">{prose()}</p></blockquote>')
            elif r < 0.85:
                out.append('<table data-y="1">' + "".join(f'<tr data-y="1"><td data-y="1">{words(1, 3)}</td><td data-y="1">{rng.randint(1, 999)}</td></tr>' for _ in range(3)) + "</table>")
            elif r < 0.87:
                out.append(f'<pre data-y="1">{words(4, 20)}</pre>')
            elif r < 0.89:
                out.append(f'<figure data-y="1"><img src="x.png"><figcaption data-y="1">{words(3, 9)}.</figcaption></figure>')
            elif r < 0.955:
                out.append(block("div", rng.choice(["ad", "advert", "promo", "sponsored", "ad-slot", "banner"]), rng.choice([prose(5, 20), f'<p data-y="0">{prose(5, 20)}</p>'])))
            elif r < 0.985:
                out.append(block("div", rng.choice(["share", "social", "related", "newsletter", "subscribe"]), menu(3)))
            else:
                out.append(f'<div data-y="1">{prose()}</div>')
        return "".join(out)

    def noise(place):
        link = f'<a href="#">{words(1, 3)}</a>'
        para = f'<p data-y="0">{prose(5, 40)}</p>'
        if place == "top":
            return rng.choice([
                block("nav", rng.choice(["", "", "top", "main-nav", "breadcrumb"]), rng.choice([menu(rng.randint(3, 7)), link * 4])),
                block("header", rng.choice(["", "site-header", "masthead", "page-header"]), rng.choice([f'<div data-y="0" class="logo">{words(1, 3)}</div>{menu(4)}', f'<h1 data-y="0">{words(1, 4)}</h1><p data-y="0">{words(3, 8)}</p>'])),
                block("div", rng.choice(["header", "topbar", "navbar", "menu", "breadcrumbs", "navigation"]), rng.choice([menu(5), link * 3, words(2, 6)])),
                block("div", rng.choice(["cookie", "cookie-notice", "notice", "consent", "alert", "banner", "gdpr"]), rng.choice([prose(6, 30), para])),
                block("div", rng.choice(["ad", "ads", "advert", "advertisement", "sponsor", "promo"]), rng.choice([prose(5, 40), para, words(2, 9)])),
                f'<form action="/s" data-y="0"><label data-y="0">{words(1, 3)}</label><input name="q"><button>{words(1, 2)}</button></form>',
            ])
        return rng.choice([
            block("footer", rng.choice(["", "", "site-footer", "footer"]), rng.choice([f"&copy; {words(1, 4)} &middot; {prose(5, 20)}", f'<p data-y="0">{prose(5, 30)}</p>{menu(4)}', link * 3])),
            block("div", rng.choice(["footer", "copyright", "legal", "bottom"]), rng.choice([prose(5, 20), para])),
            block("aside", rng.choice(["", "sidebar", "related", "widget"]), rng.choice([f'<h3 data-y="0">{words(1, 4)}</h3>{menu(4)}', para, para + para])),
            block("div", rng.choice(["sidebar", "side", "widget", "related", "related-posts", "recommended", "trending", "popular"]), rng.choice([f'<h3 data-y="0">{words(1, 4)}</h3>{menu(5)}', para + para, f'<h4 data-y="0">{words(1, 3)}</h4>{para}'])),
            block(rng.choice(["section", "div"]), rng.choice(["comments", "comment-list", "reader-comments", "discussion", "responses", "disqus"]), f'<h3 data-y="0">{words(1, 3)}</h3>' + "".join(rng.choice([f'<div class="comment" data-y="0"><p data-y="0">{prose(5, 50)}</p></div>', f'<article class="comment" data-y="0"><p data-y="0">{prose(5, 40)}</p></article>', f'<li class="comment" data-y="0">{prose(5, 40)}</li>', f'<p data-y="0">{prose(5, 40)}</p>']) for _ in range(rng.randint(1, 5)))),
            f'<form class="{rng.choice(["newsletter", "subscribe", "login", "contact", ""])}" data-y="0"><p data-y="0">{prose(5, 20)}</p><input><label data-y="0">{words(1, 4)}</label></form>',
            block("div", rng.choice(["ad", "advert", "sponsored", "promo", "ad-bottom"]), rng.choice([para, prose(5, 40)])),
            block("nav", rng.choice(["pagination", "pager", ""]), link * 3),
        ])

    def plain(kind):
        """Content without a shell that tells of it, or in an unusual one; also of very few words."""
        if kind == "text":
            return rng.choice(["<br>", "<br><br>", "\n"]).join(prose(8, 40) for _ in range(rng.randint(1, 5)))
        short = rng.random() < 0.5
        out = f'<h{rng.randint(1, 3)} data-y="1">{words(1, 7)}</h1>' if rng.random() < 0.4 else ""
        if kind == "header":
            out = f'<header data-y="1"><h1 data-y="1">{words(2, 8)}</h1>' + (f'<p data-y="1">{words(2, 8)}</p>' if rng.random() < 0.5 else "") + "</header>"
        for _ in range(rng.choice([1, 1, 2, 3, 4, 5, 6])):
            para = f'<p data-y="1">{prose(8, 20) if short else prose()}</p>'
            if kind == "details":
                para = f'<details data-y="1"><summary data-y="1">{words(1, 6)}</summary>{para}</details>'
            out += f'<div data-y="1">{prose()}</div>' if kind == "divs" and rng.random() < 0.4 else para
        if kind == "td":
            return f'<table data-y="1"><tr data-y="1"><td data-y="1">{out}</td></tr></table>'
        if kind == "named":
            return block(*rng.choice(shells), out, 1)
        if kind in ("header", "details"):
            return block(*rng.choice([("article", ""), ("main", ""), ("article", "post"), ("div", "content"), ("section", "")]), out, 1)
        if kind == "section":
            return block("section", "", out, 1)
        for _ in range(rng.randint(1, 4) if kind == "divs" else 0):
            out = f'<div data-y="1">{out}</div>' if rng.random() < 0.7 else f'<div class="{rng.choice(["wrapper", "container", "row", "site", "layout", "page"])}" data-y="1">{out}</div>'
        return out

    shells = [("article", ""), ("article", ""), ("article", "post"), ("main", ""), ("div", "content"), ("div", "article"), ("div", "post"), ("div", "entry"), ("div", "main"), ("div", "story"), ("section", "content"), ("section", "article"), ("div", "article-body"), ("div", "page"), ("div", "text"), ("section", ""), ("div", "")]
    pages = []
    for _ in range(n):
        rough = rng.random() < 0.2
        if rng.random() < 0.5:
            kind = rng.choice(["text", "body", "body", "divs", "divs", "divs", "named", "named", "header", "details", "td", "section"])
            some = rng.random() < 0.5
            top = "".join(noise("top") for _ in range(rng.randint(0, 2))) if some else ""
            end = "".join(noise("end") for _ in range(rng.randint(0, 2))) if some else ""
            inner = plain(kind)
            page = f'<body data-y="1">{top}{inner}{end}</body>'
            pages.append(rng.choice([f"<html>{page}</html>", page]) if kind != "text" or some or rng.random() < 0.7 else f'<html data-y="1">{inner}')
            continue
        tag, cls = rng.choice(shells)
        inner = block(tag, cls, body(), 1)
        if rng.random() < 0.25:
            inner = f'<main data-y="1">{inner}</main>'
        if rng.random() < 0.25:
            inner = f'<div class="{rng.choice(["wrapper", "container", "row", "site", "layout"])}" data-y="{rng.choice("01")}">{inner}{noise("end") if rng.random() < 0.5 else ""}</div>'
        top = "".join(noise("top") for _ in range(rng.randint(0, 3)))
        end = "".join(noise("end") for _ in range(rng.randint(0, 4)))
        pages.append(f"<html><body>{top}{inner}{end}</body></html>")
    return pages


class Extractor:
    def __init__(self, pages: list[str] | None = None):
        trees = [parse(p)[0] for p in (pages if pages is not None else labelled_pages())]
        self.index: dict[str, int] = {}
        forest = Forest(trees, self.index, grow=True)
        self.w, self.pair = fit(forest, len(self.index))

    def texts(self, pages: list[str]) -> list[str]:
        trees, runs = [], []
        for p in pages:
            t, r = parse(p)
            trees.append(t)
            runs.append(r)
        forest = Forest(trees, self.index)
        if not forest.n:
            return ["" for _ in pages]
        p, _ = forest.marginals(self.w, self.pair)
        return ["\n".join([text for node, text in r if p[node.order] >= 0.5]) for r in runs]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", labelled: list[str] | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page; trained here, from ``labelled`` pages."""
    common.small_batches(pages.sparkSession, 500)
    shared = pages.sparkSession.sparkContext.broadcast(Extractor(labelled))  # a few hundred weights
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("_html"))

    def run(batches):
        model = shared.value
        for b in batches:
            html, text = b.column(2).to_pylist(), []
            for lo in range(0, len(html), 100):
                text += model.texts(html[lo : lo + 100])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
