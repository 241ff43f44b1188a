"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded along the tree.

A page becomes a tree of its elements (text-less ones such as scripts and styles are left out). Every structural node gets
features: densities of its subtree (text, links, tags, paragraphs, form fields, punctuation), its attribute tokens and tag,
those of its ancestors, its depth, and statistics of its siblings. Gradient-boosted trees, fitted here in numpy, give the
chance that a node is main text. Nodes are then decided together: a dynamic program over the tree picks the most likely
choice in which everything below a dropped node is dropped, so no descendant contradicts its ancestor.

The trees are fitted on pages made up from the words of a bounded sample of the given pages, laid out in many known ways
(menus, adverts, notices, sidebars, forms, comments and footers around and inside an article), so their labels are exact.

Defined results: a null or empty page has empty text; a page without any element is one block of text; unclosed and stray
tags are closed as browsers do for paragraphs, list items and cells; quotes are read as browsers do, so a stray one is part of
a name or value; very long pages are extracted whole, in time linear in the page; repeated rows are answered alike; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, table, text_batches

#: Pages whose words are used (at most about so many, of about so many characters), and pages made up from them.
SAMPLE_PAGES, SAMPLE_BYTES, MADE_PAGES = 200, 8_000_000, 700
TREES, DEPTH, RATE, BINS = 40, 4, 0.2, 32

# Elements of HTML by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe select".split())
# Elements whose content isn't shown if they are closed, and start tags that end an svg.
HIDDEN = frozenset("svg object canvas".split())
BREAKOUT = "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
# Elements of formulas, whose text is text.
INLINE |= frozenset("math mi mn mo ms mtext mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd maction semantics annotation".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
# Attribute tokens that tell page furniture, and main text.
FURNITURE = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent copyright disclaimer discussion disqus foot footer form gdpr head header login masthead menu meta modal nav navbar navigation newsletter notice notification pager pagination popup promo promotion recommended related reply replies responses search share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar topbar widget widgets alert aside".split()
)
CONTENT = frozenset("article articlebody body content entry main maincontent post story text page hentry blog".split())
TAGS = "article aside blockquote div dl fieldset figure footer form h1 h2 h3 header li main nav ol p pre section table td ul body html".split()
TOKEN_BUCKETS = 16
# The parts of a tag: what stands between attributes, an attribute's name, the sign before its value, a value without quotes.
_TAG_NAME, _GAP, _NAME, _EQUALS, _BARE = (re.compile(x) for x in (r"[a-zA-Z][^\s/>]*", r"[\s/]*", r"=?[^\s/>=]*", r"\s*=\s*", r"[^\s>]*"))
# Elements that an element of the same group ends, unless one of SCOPE stands between them.
_GROUP = {"p": 0, "li": 1, "dt": 2, "dd": 2, "tr": 3, "td": 4, "th": 4, "option": 5}
_SCOPE = frozenset("ul ol dl table menu".split())
_WORDS = re.compile(r"[A-Za-z][a-z]*")
_BREAKOUT = re.compile(rf"<(?:{'|'.join(BREAKOUT)})(?=[\s/>])", re.I)


class Node:
    __slots__ = ("tag", "tokens", "parent", "kids", "items", "depth", "at")

    def __init__(self, tag: str, tokens: list[str], parent: Node | None):
        self.tag, self.tokens, self.parent = tag, tokens, parent
        self.kids: list[Node] = []
        self.items: list = []  # text, inline link text, breaks and child nodes, in page order
        self.depth = parent.depth + 1 if parent else 0
        self.at = 0
        if parent:
            parent.kids.append(self)
            parent.items.append(self)


class Link(str):
    """Text inside a link."""


BREAK = object()
FIELD = object()


def attributes(page: str, at: int) -> tuple[list[tuple[str, str]], int]:
    """The attributes of the tag whose name ends at ``at``, and where the tag ends. As in browsers, a quote belongs to a value
    only where the value begins with it; a value whose quote is never closed ends with the tag."""
    found, n = [], len(page)
    while True:
        at = _GAP.match(page, at).end()
        if at >= n:
            return found, n
        if page[at] == ">":
            return found, at + 1
        m = _NAME.match(page, at)
        name, at = m[0].lower(), m.end()
        m = _EQUALS.match(page, at)
        if not m:
            found.append((name, ""))
            continue
        at = m.end()
        quote = page[at : at + 1]
        if quote in ("'", '"'):
            end = page.find(quote, at + 1)
            if end >= 0:
                found.append((name, page[at + 1 : end]))
                at = end + 1
                continue
            end = page.find(">", at)
            end = n if end < 0 else end
            found.append((name, page[at + 1 : end]))
            at = end
        else:
            m = _BARE.match(page, at)
            found.append((name, m[0]))
            at = m.end()


def parse(page: str) -> Node:
    """The tree of a page: structural elements as nodes, inline elements dissolved into their text. Linear in the page."""
    root = Node("html", [], None)
    stack = [root]  # open structural nodes
    # Of each open node: where the nearest open element of each group stands that a new one of the group would end.
    reach = [(-1,) * 6]
    opened: Counter = Counter()  # open structural nodes by tag
    inline: Counter = Counter()  # open inline elements by tag
    at, begin, n = 0, 0, len(page)
    closing: dict[str, re.Pattern] = {}
    ends_at: dict[str, int | None] = {}  # of hidden elements: None if there is no end any more

    def text(end: int) -> None:
        if end > begin:
            piece = html.unescape(page[begin:end])
            stack[-1].items.append(Link(piece) if inline["a"] else piece)

    def close(i: int) -> None:
        """Close the node at a place of the stack and all above it."""
        for node in stack[i:]:
            opened[node.tag] -= 1
        del stack[i:], reach[i:]

    while True:
        start = page.find("<", at)
        if start < 0:
            break
        head = page[start + 1 : start + 3]
        if head[:1] in ("!", "?") or (head[:1] == "/" and not head[1:].isalpha()):
            text(start)
            # All but comments end at the next ">", marked sections too.
            mark, skip = ("-->", 2) if page.startswith("<!--", start) else (">", 1)
            end = page.find(mark, start + skip)
            at = begin = n if end < 0 else end + len(mark)
            continue
        m = _TAG_NAME.match(page, start + (2 if head[:1] == "/" else 1))
        if not m:  # a "<" in the text
            at = start + 1
            continue
        text(start)
        tag, at = m[0].lower(), m.end()
        if page[at : at + 1] == ">":
            rest, at = [], at + 1
        else:
            rest, at = attributes(page, at)
        begin = at
        if head[:1] == "/":
            if tag in INLINE:
                if inline[tag]:
                    inline[tag] -= 1
                elif len(stack) > 1 and stack[-1].tag == tag:
                    close(len(stack) - 1)
            elif tag == "br":
                stack[-1].items.append(BREAK)
            elif opened[tag]:
                i = len(stack) - 1
                while stack[i].tag != tag:
                    i -= 1
                close(i)
                inline.clear()
            continue
        if tag in VOID:
            stack[-1].items.append(FIELD if tag == "input" else BREAK)
            continue
        if tag in RAW:
            if page[at - 2 : at] != "/>":
                end = closing.get(tag) or closing.setdefault(tag, re.compile(rf"</{tag}\s*>", re.I))
                e = end.search(page, at)
                at = begin = e.end() if e else n
            if tag in ("textarea", "select"):
                stack[-1].items.append(FIELD)
            continue
        if tag in HIDDEN:
            # Without an end nothing is hidden, and an svg ends where an element of the page begins.
            if page[at - 2 : at] != "/>" and ends_at.get(tag, 0) is not None:
                e = (closing.get(tag) or closing.setdefault(tag, re.compile(rf"</{tag}\s*>", re.I))).search(page, at)
                ends_at[tag] = e and e.end()
                b = _BREAKOUT.search(page, at, e.start()) if e and tag == "svg" else None
                if e:
                    at = begin = b.start() if b else e.end()
            continue
        if tag in ("html", "head"):
            continue
        tokens = [w.lower() for name, value in rest if name in ("class", "id", "role") for w in _WORDS.findall(value)] if rest else []
        if tag in INLINE and not tokens:
            inline[tag] += 1
            continue
        if tag == "button":
            stack[-1].items.append(FIELD)
        group = _GROUP.get(tag)
        ends = reach[-1][0 if tag in CLOSES_P else group] if tag in CLOSES_P or group is not None else -1
        if ends > 0:
            close(ends)
            inline.clear()
        if tag not in INLINE:
            links = inline["a"]
            inline.clear()
            inline["a"] = links
        below = reach[-1]
        stack.append(Node(tag, tokens, stack[-1]))
        opened[tag] += 1
        here = len(stack) - 1
        if tag not in INLINE:  # paragraphs are ended through inline elements only, the other groups through all but SCOPE
            below = (-1, -1, -1, -1, -1, -1) if tag in _SCOPE else (-1, *below[1:])
            if group is not None:
                below = (*below[:group], here, *below[group + 1 :])
        reach.append(below)
    text(n)
    return root


def nodes_of(root: Node) -> list[Node]:
    """All nodes, parents first."""
    out = [root]
    for n in out:
        out.extend(n.kids)
    for i, n in enumerate(out):
        n.at = i
    return out


_log = math.log1p


WIDTH = 30 + len(TAGS) + TOKEN_BUCKETS


def features(nodes: list[Node]) -> np.ndarray:
    n = len(nodes)
    x = np.zeros((n, WIDTH), np.float32)
    own = np.zeros((n, 7))  # characters, in links, elements, paragraphs, list items, fields, punctuation
    for i, node in enumerate(nodes):
        chars = links = fields = marks = 0
        for item in node.items:
            if item is FIELD:
                fields += 1
            elif isinstance(item, str):
                size = len(item)
                chars += size
                marks += item.count(".") + item.count(",")
                if isinstance(item, Link):
                    links += size
        own[i] = chars, links, 1, node.tag == "p", node.tag == "li", fields, marks
    sub = own.copy()
    for i in range(n - 1, 0, -1):
        sub[nodes[i].parent.at] += sub[i]
    total = max(1.0, sub[0, 0])
    bad, good = np.zeros(n), np.zeros(n)
    up_bad, up_good = np.zeros(n), np.zeros(n)
    section, place = np.zeros(n), np.zeros(n)
    alike: dict[int, Counter] = {}
    for i, node in enumerate(nodes):
        tag, tokens = node.tag, node.tokens
        bad[i] = sum(t in FURNITURE for t in tokens) + (tag in ("nav", "footer", "header", "aside", "form", "fieldset", "ins"))
        good[i] = sum(t in CONTENT for t in tokens) + (tag in ("article", "main"))
        p = node.parent
        if node.kids:
            alike[i] = Counter(k.tag for k in node.kids)
            place[[k.at for k in node.kids]] = np.arange(len(node.kids)) / len(node.kids)
        if p:
            up_bad[i], up_good[i] = up_bad[p.at] + bad[p.at], up_good[p.at] + good[p.at]
            section[i] = section[p.at]
        if tag in ("nav", "footer", "header", "aside", "form"):
            section[i] = -1
        elif tag in ("article", "main"):
            section[i] = 1
        elif bad[i] or good[i]:
            section[i] = 1 if good[i] > bad[i] else -1
        kids = p.kids if p else [node]
        chars, links, elements, ps, lis, fields, marks = sub[i]
        around = sub[p.at, 0] if p else chars
        x[i, :30] = (
            node.depth, len(node.kids), len(kids), alike[p.at][tag] / len(kids) if p else 1, place[i],
            _log(chars), chars / total, chars / max(1.0, around), links / max(1.0, chars), _log(elements), _log(chars / elements), _log(ps), _log(lis), _log(fields),
            marks / max(1.0, chars) * 100, _log(own[i, 0]), own[i, 0] / max(1.0, chars), _log(chars / max(1.0, ps)), len(tokens), bad[i], good[i], up_bad[i], up_good[i], section[i],
            section[p.at] if p else 0, tag in INLINE, bool(p and p.tag == "body"), bool(p and p.tag == "article"), bool(p and p.tag in ("ul", "ol")), i / n,
        )
        if tag in TAGS:
            x[i, 30 + TAGS.index(tag)] = 1
        for t in tokens:
            x[i, 30 + len(TAGS) + sum(map(ord, t)) % TOKEN_BUCKETS] = 1
    return x


# ---------------------------------------------------------------- gradient-boosted trees


@dataclass
class Boosted:
    """Complete trees of one depth: the feature and threshold of every inner node, the value of every leaf."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - (2**DEPTH - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray) -> Boosted:
    """Logistic loss, histogram splits, second-order gains."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    base = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    f, trees = np.full(n, base), []
    inner, span = 2**DEPTH - 1, np.arange(width) * (BINS + 1)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        feat, thr, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        for node in range(inner):
            rows = np.flatnonzero(at == node)
            if len(rows) >= 10:
                keys = (binned[rows] + span).ravel()
                gs = np.bincount(keys, np.repeat(g[rows], width), width * (BINS + 1)).reshape(width, -1).cumsum(axis=1)
                hs = np.bincount(keys, np.repeat(h[rows], width), width * (BINS + 1)).reshape(width, -1).cumsum(axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                for j, e in enumerate(edges):
                    gain[j, len(e) :] = -1
                j, b = divmod(int(gain.argmax()), BINS + 1)
                if gain[j, b] > 1e-3:
                    feat[node], thr[node] = j, edges[j][b]
            at[rows] = 2 * node + 1 + (x[rows, feat[node]] > thr[node])
        leaf = at - inner
        value = RATE * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + 1)
        f += value[leaf]
        trees.append((feat, thr, value))
    return Boosted(base, *[np.stack(t) for t in zip(*trees, strict=True)])


# ---------------------------------------------------------------- made-up pages with known main text


def made_page(rng: np.random.Generator, words: list[str]) -> str:
    """A page whose main text stands in elements marked data-main."""

    def some(lo: int, hi: int) -> str:
        at = int(rng.integers(0, max(1, len(words) - hi)))
        return html.escape(" ".join(words[at : at + int(rng.integers(lo, hi + 1))]), quote=False)

    def pick(*options: str) -> str:
        return options[int(rng.integers(len(options)))]

    def maybe(share: float, make) -> str:
        return make() if rng.random() < share else ""

    def links(lo: int, hi: int) -> str:
        return "".join(f'<li><a href="/{k}">{some(1, 3)}</a></li>' for k in range(int(rng.integers(lo, hi))))

    def advert() -> str:
        return f'<{(t := pick("div", "aside", "section"))} class="{pick("ad", "ads", "advert", "ad-box", "banner", "promo", "sponsored")}">{pick("", "<p>")}{some(3, 40)}</{t}>'

    def notice() -> str:
        return f'<div {pick("class", "id")}="{pick("notice", "cookie-notice", "consent", "alert", "gdpr-banner", "popup")}"><p>{some(4, 40)}</p>{maybe(0.5, lambda: "<button>" + some(1, 1) + "</button>")}</div>'

    def menu() -> str:
        return pick(f"<nav><ul>{links(2, 9)}</ul></nav>", f'<div class="{pick("menu", "navbar", "nav", "breadcrumbs")}"><ul>{links(2, 9)}</ul></div>', f'<ul class="{pick("menu", "navigation")}">{links(3, 9)}</ul>')

    def form() -> str:
        return f'<form{pick("", " class=search", " class=newsletter")}><label>{some(1, 4)}</label><input name=q>{maybe(0.5, lambda: "<textarea></textarea>")}{maybe(0.6, lambda: "<p>" + some(4, 25))}<button>{some(1, 2)}</button></form>'

    def comments() -> str:
        one = "".join(f'<{(t := pick("div", "li", "article"))} class="{pick("comment", "reply", "comment-body")}">{pick("<p>", "")}{some(5, 90)}</{t}>' for _ in range(int(rng.integers(1, 6))))
        return f'<{(t := pick("section", "div"))} {pick("id", "class")}="{pick("comments", "comment-list", "discussion", "responses", "reader-comments")}">{maybe(0.6, lambda: "<h3>" + some(1, 4) + "</h3>")}{one}</{t}>'

    def sidebar() -> str:
        inner = "".join(pick(f"<p>{some(5, 50)}</p>", f"<ul>{links(2, 7)}</ul>", f"<h3>{some(1, 4)}</h3>") for _ in range(int(rng.integers(1, 5))))
        return pick(f"<aside>{inner}</aside>", f'<div {pick("class", "id")}="{pick("sidebar", "widget", "related", "recommended")}">{inner}</div>')

    def paragraph() -> str:
        kind = rng.random()
        body = some(2, 120)
        if kind < 0.1:
            return f"<ul data-main>{''.join(f'<li data-main>{some(1, 20)}</li>' for _ in range(int(rng.integers(1, 6))))}</ul>"
        if kind < 0.15:
            return f"<blockquote data-main><p data-main>{body}</p></blockquote>"
        if kind < 0.2:
            return f"<table data-main><tr data-main><td data-main>{some(1, 6)}</td><td data-main>{some(1, 6)}</td></tr></table>"
        if kind < 0.3:
            return f"<h2 data-main>{some(1, 8)}</h2>"
        if kind < 0.4:
            return f'<p data-main>{some(2, 30)} <a href="/x">{some(1, 5)}</a> {some(1, 30)}</p>'
        return f"<p data-main>{pick('', '<b>')}{body}{pick('', '<br>')}{pick('', '</p>')}"

    parts = [f"<h1 data-main>{some(1, 9)}</h1>"] if rng.random() < 0.85 else []
    for _ in range(int(rng.choice([1, 2, 3, 5, 8, 14]))):
        parts.append(paragraph())
        parts.append(maybe(0.06, lambda: pick(advert(), sidebar(), form(), notice(), f'<div class="{pick("share", "social", "tags")}"><ul>{links(1, 4)}</ul></div>')))
    inside = "".join(parts) + maybe(0.1, comments)
    main = pick(f"<article data-main>{inside}</article>", f"<article data-main>{inside}</article>", f"<main data-main>{inside}</main>", f'<main data-main><article data-main class="{pick("post", "entry")}">{inside}</article></main>', f'<div data-main {pick("class", "id")}="{pick("content", "post", "entry", "story", "article-body", "main-content", "post-text")}">{inside}</div>', f"<div data-main>{inside}</div>")
    head = "".join([maybe(0.4, lambda: f"<header>{maybe(0.7, lambda: '<h1>' + some(1, 4) + '</h1>')}{some(1, 8)}</header>"), maybe(0.9, menu), maybe(0.25, notice), maybe(0.6, advert), maybe(0.1, form)])
    tail = "".join([maybe(0.3, comments), maybe(0.3, sidebar), maybe(0.2, form), maybe(0.15, advert), maybe(0.8, lambda: pick(f"<footer>&copy; {some(2, 30)}</footer>", f"<footer><p>{some(2, 30)}</p><ul>{links(1, 5)}</ul></footer>", f'<div class="{pick("footer", "site-footer", "copyright")}">{some(2, 30)}</div>'))])
    if rng.random() < 0.25:
        main = f'<div data-main class="{pick("wrapper", "container", "row", "layout", "page")}">{main}{maybe(0.5, sidebar)}</div>'
    return f"<html><head><title>{some(1, 6)}</title></head><body data-main>{head}{main}{tail}</body></html>"


_MARK = re.compile(r" data-main\b")


def fit_on(texts: list[str], seed: int = 3) -> Boosted:
    """Trees for pages made up from these texts."""
    rng = np.random.default_rng(seed)
    words = " ".join(texts).split() or "the text of a page without any word in its sample".split()
    xs, ys = [], []
    for _ in range(MADE_PAGES):
        page = made_page(rng, words)
        # The mark is read as one more attribute token, then taken off before features are made.
        nodes = nodes_of(parse(_MARK.sub(' role="zzmain"', page)))
        ys.append(np.array([n.tag == "html" or "zzmain" in n.tokens for n in nodes], float))
        for n in nodes:
            n.tokens = [t for t in n.tokens if t != "zzmain"]
        xs.append(features(nodes))
    return boost(np.concatenate(xs), np.concatenate(ys))


# ---------------------------------------------------------------- decoding


def decode(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """Which nodes stay: the most likely choice in which all below a dropped node is dropped."""
    keep, drop = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    best, gone = keep.copy(), drop.copy()
    for i in range(len(nodes) - 1, 0, -1):
        p = nodes[i].parent.at
        best[p] += max(best[i], gone[i])
        gone[p] += gone[i]
    stays = np.zeros(len(nodes), bool)
    stays[0] = True
    for i in range(1, len(nodes)):
        stays[i] = stays[nodes[i].parent.at] and best[i] >= gone[i]
    return stays


def text_of(root: Node, stays: np.ndarray) -> str:
    """The text of the nodes that stay, in page order; blocks and breaks are parted by a space."""
    out: list[str] = []
    todo: list = [root]
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            out.append(item)
        elif item is BREAK or item is FIELD:
            out.append(" ")
        elif isinstance(item, Node):
            space = "" if item.tag in INLINE else " "
            if stays[item.at]:
                todo.append(space)
                todo.extend(reversed(item.items))
            if space:
                todo.append(space)
    return " ".join("".join(out).split())


def extract_pages(pages: list[str | None], model: Boosted) -> list[str]:
    trees = [nodes_of(parse(p)) if p else None for p in pages]
    held = [t for t in trees if t]
    if not held:
        return [""] * len(pages)
    odds = model.log_odds(np.concatenate([features(t) for t in held]))
    out, at = [], 0
    for t in trees:
        if t is None:
            out.append("")
            continue
        out.append(text_of(t[0], decode(t, odds[at : at + len(t)])))
        at += len(t)
    return out


def fit(pages: DataFrame, key: str = "page_id", page: str = "html") -> Boosted:
    """Trees for pages made up from whole pages of a sample of about SAMPLE_PAGES pages, and about SAMPLE_BYTES characters."""
    rows = pages.where(F.col(page).isNotNull()).select(key, F.col(page).alias("_h"))
    got = bounded_sample(rows, key, SAMPLE_PAGES, "_h", SAMPLE_BYTES).toPandas().sort_values([key, "_h"], kind="stable")
    texts = []
    for h in got["_h"]:
        root = parse(h)
        texts.append(text_of(root, np.ones(len(nodes_of(root)), bool)))
    return fit_on(texts)


def extract(df: DataFrame, model: Boosted, page: str = "html", out: str = "text") -> DataFrame:
    """Add the main text of every page."""
    spark = df.sparkSession
    text_batches(spark, 256)
    shared = spark.sparkContext.broadcast(model)  # of fixed size

    @F.pandas_udf("string")
    def texts(pages: pd.Series) -> pd.Series:
        return pd.Series(extract_pages([p if isinstance(p, str) else None for p in pages], shared.value))

    return df.withColumn(out, texts(F.col(page)))


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return extract(pages, fit(pages)).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


#: The given pages hold their main text in one article element, which SQL can cut out.
ORACLE_OP1 = r"""
WITH a AS (SELECT page_id, url, coalesce(regexp_extract(html, '<article>(.*)</article>', 1, 's'), '') AS h FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(h, '</?(b|a|i|em|strong)( [^>]*)?>', '', 'g'), '<[^>]*>', ' ', 'g') AS h FROM a),
c AS (SELECT page_id, url, replace(replace(replace(replace(regexp_replace(h, '&(lt|gt|quot|amp)([^;]|$)', '&\1;\2', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS h FROM b)
SELECT page_id, url, trim(regexp_replace(h, '\s+', ' ', 'g')) AS text, length(trim(regexp_replace(h, '\s+', ' ', 'g'))) AS n_chars FROM c
"""
