"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded from the top of the tree down.

Each block element of a page, and each inline one with a class, id or role, is a node with features of its subtree (how dense
its text is, how much of it is links), of its tag and attribute tokens, its depth and its siblings. What a token says is learnt: its
weight is the log-odds of being dropped that nodes with it have in the training pages. Boosted trees give the odds that a node belongs to the main
text. The decoding finds the most likely labels in which nothing inside a dropped node is kept, so no choice contradicts
an ancestor's.

The trees are trained here, on pages that `sample_pages` makes up with known labels: a bounded number of them
(TRAIN_PAGES) from a seed, laid out in many ways. No page of the input is used for training.
"""

from __future__ import annotations

import functools
import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read

#: How many made-up pages the trees are trained on, from which seed.
TRAIN_PAGES, SEED = 600, 11

_START = re.compile(r"([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_TOKEN = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_RAW = {x: re.compile(rf"</{x}\s*(?:>|\Z)", re.I) for x in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes")}
#: Never text: what these hold is markup, code or controls.
_NEVER = {*_RAW, "head", "svg", "math", "canvas", "object", "select", "button", "datalist", "audio", "video", "map"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr", "keygen", "frame"}
_BLOCK = {
    *"address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup html".split(),
    *"legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split(),
}
_CLOSES_P = _BLOCK - {"dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body", "option", "optgroup", "legend"} | {"hr", "dd", "dt"}
#: A start tag closes an open element of these kinds, up to the nearest of the second set.
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
}
TAGS = ["p", "div", "article", "main", "section", "nav", "header", "footer", "aside", "form", "ul", "ol", "li", "h1", "h2", "h3", "table", "td", "blockquote", "pre", "figure", "body"]


class Node:
    __slots__ = ("tag", "parent", "depth", "tokens", "kids", "links", "chars", "link_chars", "hidden", "index")

    def __init__(self, tag: str, parent: Node | None, tokens: frozenset[str], hidden: bool) -> None:
        self.tag, self.parent, self.depth, self.tokens, self.hidden = tag, parent, parent.depth + 1 if parent else 0, tokens, hidden
        self.kids: list[Node] = []
        self.chars = self.link_chars = self.links = 0


#: A block of text: the number of the block element that it stands in, and its parts, each with the number of its own node.
Block = tuple[int, list[tuple[int, str]]]


def _attributes(raw: str) -> tuple[frozenset[str], bool]:
    tokens, hidden = set(), False
    if raw and not raw.isspace():
        for name, *value in _ATTR.findall(raw):
            v, name = "".join(value), name.lower()
            if name in ("class", "id", "role", "itemprop", "aria-label", "data-component"):
                tokens.update(_TOKEN.findall(_CAMEL.sub(" ", v).lower()))
            elif name == "hidden" or name == "aria-hidden" and v == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", v):
                hidden = True
    return frozenset(tokens), hidden


def parse(html: str) -> tuple[list[Node], list[Block]]:
    """The nodes of a page in its order, and its blocks of text.

    Tags may be open, crossed or missing. Inline elements belong to the block around them; those that are nodes are parts of it.
    Character references are decoded after the markup is split. The time is linear in the page's length however broken it
    is: open elements are found by name, and once a tag's quotes don't close, tags end at the next > from there on.
    """
    root = Node("html", None, frozenset(), False)
    nodes, blocks, buffer = [root], [], []
    stack: list[tuple[Node, str]] = [(root, "html")]
    open_at: dict[str, list[int]] = {}
    block_at: list[int] = []
    root.index, at, n, never, links, quotes = 0, 0, len(html), 0, 0, True

    def flush() -> None:
        if buffer:
            parts = [(i, entities.unescape(t)) for i, t in buffer]
            buffer.clear()
            for i, t in parts:
                nodes[i].chars += len(t.strip())
            if any(not t.isspace() for _, t in parts):
                blocks.append((stack[block_at[-1]][0].index if block_at else 0, parts))

    def pop(i: int) -> None:
        nonlocal never, links
        if block_at and block_at[-1] >= i:
            flush()
        for _, tag in stack[i:]:
            open_at[tag].pop()
            never -= tag in _NEVER
            links -= tag == "a"
        while block_at and block_at[-1] >= i:
            block_at.pop()
        del stack[i:]

    def last(tags) -> int:
        return max((open_at[t][-1] for t in tags if open_at.get(t)), default=0)

    while at < n:
        lt = html.find("<", at)
        end = lt if lt >= 0 else n
        if end > at and not never:
            buffer.append((stack[-1][0].index, html[at:end]))
            if links:
                stack[-1][0].link_chars += end - at
        if lt < 0:
            break
        begin = lt + 1
        c = html[begin : begin + 1]
        if c in ("!", "?"):
            stop = "-->" if html.startswith("!--", begin) else ">"
            end = html.find(stop, begin + (3 if stop == "-->" else 0))
            at = end + len(stop) if end >= 0 else n
            continue
        closes = c == "/"
        begin += closes
        c = html[begin : begin + 1]
        if not (c.isascii() and c.isalpha()):
            if closes:
                end = html.find(">", begin)
                at = end + 1 if end >= 0 else n
            else:
                if not never:
                    buffer.append((stack[-1][0].index, "<"))
                at = begin
            continue
        m = _START.match(html, begin) if quotes else None
        if m:
            tag, raw, at = m[1].lower(), m[2], m.end()
        else:
            quotes = False
            end = html.find(">", begin)
            if end < 0:
                break
            name = _NAME.match(html, begin, end)
            tag, raw, at = name[0].lower(), html[name.end() : end], end + 1
        if closes:
            i = open_at[tag][-1] if open_at.get(tag) else 0
            if i and (tag in _BLOCK or not block_at or i > block_at[-1]):  # an inline end tag does not close blocks
                pop(i)
            elif tag in _BLOCK:
                flush()
            continue
        if tag in _CLOSES_P and block_at and stack[block_at[-1]][1] == "p":
            pop(block_at[-1])
        if tag in _IMPLIED:
            kinds, stop = _IMPLIED[tag]
            if (i := last(kinds)) > last(stop):
                pop(i)
        if tag in ("body", "html") and (i := last(("head",))):
            pop(i)
        if tag in _VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                buffer.append((stack[-1][0].index, " "))
            continue
        if tag in _RAW and not raw.endswith("/"):
            close = _RAW[tag].search(html, at)
            at = close.end() if close else n
            buffer.append((stack[-1][0].index, " "))
            continue
        tokens, hidden = _attributes(raw)
        if tag in _BLOCK:
            flush()
            block_at.append(len(stack))
        open_at.setdefault(tag, []).append(len(stack))
        if tag in _BLOCK or tokens or hidden:
            node = Node(tag, stack[-1][0], tokens, hidden)
            node.index = len(nodes)
            node.parent.kids.append(node)
            nodes.append(node)
            stack.append((node, tag))
        else:
            stack.append((stack[-1][0], tag))
        if tag == "a":
            stack[-1][0].links += 1
        never += tag in _NEVER
        links += tag == "a"
    flush()
    return nodes, blocks


def token_weights(pages: list[tuple[list[Node], np.ndarray]]) -> dict[str, float]:
    """What each attribute token and tag, and each token's first four letters, says for being dropped: log-odds, over nodes whose parent stays."""
    count: dict[str, list[int]] = {}
    for nodes, y in pages:
        for x in nodes[1:]:
            if y[x.parent.index] > 0.5:
                for t in _marks(x):
                    count.setdefault(t, [1, 1])[int(y[x.index] > 0.5)] += 1
    return {t: float(np.log(a / b)) for t, (a, b) in count.items()}


def _marks(x: Node) -> set[str]:
    return {f"<{x.tag}>", *x.tokens, *(f"{t[:4]}-" for t in x.tokens if len(t) > 3)}


def features(nodes: list[Node], blocks: list[Block], weights: dict[str, float] | None = None) -> np.ndarray:
    """One row of numbers for each node. weights: what tokens say, as token_weights() gives it."""
    n, known = len(nodes), weights or {}
    chars, links, link_chars, paragraphs, stops, size, long = (np.zeros(n) for _ in range(7))
    for i, parts in blocks:
        paragraphs[i] += nodes[i].tag == "p"
        for k, t in parts:
            stops[k] += t.count(". ") + t.count(", ") + t.rstrip().endswith(".")
        long[i] += sum(len(t) for _, t in parts) > 80
    for x in nodes:
        chars[x.index], links[x.index], link_chars[x.index] = x.chars, x.links, min(x.link_chars, x.chars)
    size += 1
    for x in reversed(nodes[1:]):
        for a in (chars, links, link_chars, paragraphs, stops, size, long):
            a[x.parent.index] += a[x.index]
    total = max(1.0, chars[0])
    says, above = np.zeros((n, 3)), np.zeros((n, 2))
    tags = [Counter(k.tag for k in x.kids) for x in nodes]
    rows = np.zeros((n, 25 + len(TAGS)), np.float32)
    seen = 0.0
    for x in nodes:
        i, p = x.index, x.parent
        # A token that is not known speaks by its first letters.
        own = [known[t] if t in known else known.get(f"{t[:4]}-", 0.0) for t in x.tokens]
        says[i] = max([0.0, *own]), min([0.0, *own]), known.get(f"<{x.tag}>", 0.0)
        if p:
            above[i] = max(above[p.index, 0], says[p.index, 0], says[p.index, 2]), min(above[p.index, 1], says[p.index, 1], says[p.index, 2])
        sibs = len(p.kids) if p else 1
        of_parent = chars[i] / max(1.0, chars[p.index]) if p else 1.0
        same = tags[p.index][x.tag] / sibs if p else 1.0
        rows[i, :25] = (
            np.log1p(chars[i]), chars[i] / total, chars[i] / size[i], link_chars[i] / max(1.0, chars[i]), links[i] / size[i], np.log1p(links[i]),
            paragraphs[i], stops[i] / max(1.0, chars[i]) * 100, np.log1p(size[i]), long[i], x.depth, sibs, of_parent, same, i / n, seen / total,
            *says[i], *above[i], len(x.tokens), x.hidden, np.log1p(x.chars), bool(x.parent and x.parent.tag in ("ul", "ol", "menu")),
        )
        if x.tag in TAGS:
            rows[i, 25 + TAGS.index(x.tag)] = 1
        seen += x.chars
    return rows


def boost(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, bins: int = 32, rate: float = 0.25, least: float = 4.0) -> dict:
    """Gradient-boosted regression trees for log-odds: splits by gain of second order over binned features."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
    base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    f, out = np.full(len(y), base), []
    nodes = 2 ** (depth + 1) - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        feature, cut, value, at = np.zeros(nodes, np.int64), np.full(nodes, np.inf), np.zeros(nodes), np.zeros(len(y), np.int64)
        for node in range(nodes):
            rows = np.flatnonzero(at == node)
            if not len(rows):
                continue
            gs, hs = g[rows].sum(), h[rows].sum()
            value[node] = rate * gs / (hs + 1)
            if node >= 2**depth - 1 or hs < 2 * least:
                continue
            top = (1e-6, -1, 0)
            for j in range(x.shape[1]):
                if not len(cuts[j]):
                    continue
                b = binned[rows, j]
                gl = np.cumsum(np.bincount(b, g[rows], len(cuts[j]) + 1))[:-1]
                hl = np.cumsum(np.bincount(b, h[rows], len(cuts[j]) + 1))[:-1]
                gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                gain[(hl < least) | (hs - hl < least)] = 0
                if gain.max() > top[0]:
                    top = (gain.max(), j, int(gain.argmax()))
            if top[1] >= 0:
                feature[node], cut[node] = top[1], cuts[top[1]][top[2]]
                at[rows] = 2 * node + 1 + (binned[rows, top[1]] > top[2])
        f += value[at]
        out.append((feature, cut, value))
    return {"base": base, "depth": depth, "trees": out}


def log_odds(model: dict, x: np.ndarray) -> np.ndarray:
    f = np.full(len(x), model["base"])
    rows = np.arange(len(x))
    for feature, cut, value in model["trees"]:
        at, leaf = np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        for _ in range(model["depth"]):
            leaf |= np.isinf(cut[at])
            at = np.where(leaf, at, 2 * at + 1 + (x[rows, feature[at]] > cut[at]))
        f += value[at]
    return f


def decode(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """The most likely labels in which every node below a dropped one is dropped."""
    odds = np.clip(odds, -8, 8)
    keep, drop = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    all_dropped = drop.copy()
    for x in reversed(nodes[1:]):
        all_dropped[x.parent.index] += all_dropped[x.index]
    best = keep.copy()
    for x in reversed(nodes[1:]):
        best[x.parent.index] += max(best[x.index], all_dropped[x.index])
    kept = np.zeros(len(nodes), bool)
    kept[0] = True  # the root is the page
    for x in nodes[1:]:
        kept[x.index] = kept[x.parent.index] and not x.hidden and best[x.index] >= all_dropped[x.index]
    return kept


# --- pages to train on -------------------------------------------------------------------------------------------------

_SYL = "an en er in on th ti re nd ha ou ea st es ed or it at is ar le se de la ra un so me vo ka mi lo ne".split()


#: Classes of inline elements that the made-up pages keep and drop.
INLINE_KEPT = ("term", "name", "date", "highlight", "hl", "author", "quote", "num", "keyword", "place", "note-ref", "link", "external", "w", "lead", "dropcap", "amount", "caption", "title", "info")
INLINE_GONE = ("ad", "sponsored", "promo", "share", "tooltip", "edit-link", "print", "permalink", "reply", "advert", "more-link", "badge", "icon")


def _words(r: random.Random, n: int, stop: bool = True) -> str:
    w = ["".join(r.choices(_SYL, k=r.randint(1, 4))) + ("," if stop and r.random() < 0.08 else "") for _ in range(n)]
    out, at = [], 0
    while stop and at < len(w):
        k = r.randint(3, 18)
        s = " ".join(w[at : at + k])
        out.append(s[:1].upper() + s[1:].rstrip(",") + ".")
        at += k
    return " ".join(out) if stop else " ".join(w).title()


def sample_pages(count: int = TRAIN_PAGES, seed: int = SEED) -> Iterator[str]:
    """Pages with known labels. Block elements carry data-y: 1 for the main text and all that holds some of it, 0 for the rest."""
    r = random.Random(seed)

    def box(kind: str, names: list[str], tags: list[str], inner: str, y: int) -> str:
        tag, how = r.choice(tags), r.random()
        name = r.choice(names) if names else kind
        marks = "" if how < 0.15 and tag != "div" else f' class="{name}"' if how < 0.6 else f' id="{name}"' if how < 0.85 else f' class="{r.choice(["c1", "wrap", "box", "row"])} {name}"'
        return f"<{tag}{marks} data-y={y}>{inner}</{tag}>"

    def links(n: int) -> str:
        a = [f'<a href="/{i}">{_words(r, r.randint(1, 4), False)}</a>' for i in range(n)]
        if r.random() < 0.7:
            return "<ul data-y=0>" + "".join(f"<li data-y=0>{x}</li>" for x in a) + "</ul>"
        return r.choice([" | ", " ", " &middot; "]).join(a)

    def para(n: int, y: int) -> str:
        body = _words(r, n)
        if r.random() < 0.2:
            w = body.split(" ")
            i = r.randrange(len(w))
            w[i] = r.choice(['<a href="#">{}</a>', "<b>{}</b>", "<em>{}</em>", "<span>{}</span>"]).format(w[i])
            if r.random() < 0.4:
                i = r.randrange(len(w))
                w[i] = f'<{(tag := r.choice(["span", "em", "a", "b", "abbr"]))} class="{r.choice(INLINE_KEPT)}" data-y={y}>{w[i]}</{tag}>'
            if r.random() < 0.25:
                w.insert(r.randrange(len(w)), f'<{(tag := r.choice(["span", "a", "b"]))} class="{r.choice(INLINE_GONE)}" data-y=0>{_words(r, r.randint(1, 6), False)}</{tag}>')
            body = " ".join(w)
        return f"<p data-y={y}>{body}" + ("</p>" if r.random() < 0.85 else "")

    def noise() -> str:
        kind = r.choice(["nav", "nav", "ad", "side", "comments", "cookie", "share", "related", "form", "crumbs"])
        p = lambda a, b: para(r.randint(a, b), 0) if r.random() < 0.6 else _words(r, r.randint(a, b))
        return {
            "nav": lambda: box("nav", ["nav", "menu", "main-menu", "navbar", "navigation", "site-nav", "topbar", "toolbar", "menus", "toc", "skip-links", "tabs", "dropdown", "pager"], ["nav", "nav", "div", "ul"], links(r.randint(2, 14)), 0),
            "ad": lambda: box("ad", ["ad", "ads", "adv", "advert", "adverts", "ad-box", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "promoted", "banner", "dfp-slot"], ["div", "div", "aside", "section"], p(3, 40), 0),
            "side": lambda: box("sidebar", ["sidebar", "side", "aside", "widget", "widgets", "right-rail", "popular", "tags", "tagcloud", "blogroll"], ["aside", "aside", "div"], "".join(r.choice([lambda: f"<h3 data-y=0>{_words(r, 3, False)}</h3>", lambda: links(5), lambda: p(8, 60)])() for _ in range(r.randint(1, 5))), 0),
            "comments": lambda: box("comments", ["comments", "comment-list", "discussion", "replies", "reader-comments", "responses", "respond", "disqus", "feedback", "ratings"], ["section", "div", "ol"], "".join(box("comment", ["comment", "reply"], ["div", "li", "article"], p(4, 90), 0) for _ in range(r.randint(1, 8))), 0),
            "cookie": lambda: box("cookie", ["cookie-notice", "cookie", "cookies", "notice", "notices", "consent", "gdpr-banner", "alert", "popup", "modal", "overlay", "disclaimer", "legal", "copyright"], ["div", "section", "aside"], p(6, 40), 0),
            "share": lambda: box("share", ["share", "sharing", "social", "share-buttons", "follow-us", "print", "email-this"], ["div", "ul", "p"], links(4), 0),
            "related": lambda: box("related", ["related", "related-posts", "recommended", "recommendations", "more-stories", "more", "trending", "latest", "read-next"], ["div", "section", "aside"], f"<h3 data-y=0>{_words(r, 2, False)}</h3>" + links(r.randint(2, 6)) + (p(5, 30) if r.random() < 0.4 else ""), 0),
            "form": lambda: box("form", ["newsletter", "subscribe", "subscription", "search", "login", "signup", "register", "contact-form"], ["form", "form", "div"], f"<label>{_words(r, 3)}</label><input name=q>" + p(3, 25), 0),
            "crumbs": lambda: box("crumbs", ["breadcrumb", "breadcrumbs", "crumbs", "pagination", "pages"], ["div", "nav", "ol"], links(3), 0),
        }[kind]()

    def story() -> str:
        out = [f"<{r.choice(['h1', 'h1', 'h2'])} data-y=1>{_words(r, r.randint(2, 12), r.random() < 0.5)}</h1>"] if r.random() < 0.85 else []
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 14])):
            k = r.random()
            if k < 0.72:
                out.append(para(r.choice([2, 6, 15, 40, 90, 160]), 1))
            elif k < 0.8:
                out.append(f"<h2 data-y=1>{_words(r, r.randint(1, 6), False)}</h2>")
            elif k < 0.87:
                out.append("<ul data-y=1>" + "".join(f"<li data-y=1>{_words(r, r.randint(2, 25))}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif k < 0.9:
                out.append(f"<blockquote data-y=1>{para(r.randint(5, 40), 1)}</blockquote>")
            elif k < 0.92:
                out.append(f"<pre data-y=1>{_words(r, r.randint(4, 30))}</pre>")
            elif k < 0.94:
                out.append("<table data-y=1>" + "".join("<tr data-y=1>" + "".join(f"<td data-y=1>{_words(r, r.randint(1, 4))}</td>" for _ in range(3)) + "</tr>" for _ in range(3)) + "</table>")
            else:
                out.append(noise())
        if r.random() < 0.15:
            out.insert(0, f"<header data-y=0><p data-y=0>{_words(r, r.randint(2, 10))}</p></header>")
        if r.random() < 0.15:
            out.append(f"<footer data-y=0>{_words(r, r.randint(2, 14))}</footer>")
        return "".join(out)

    for _ in range(count):
        main = story()
        bare = r.random() < 0.12
        if not bare:
            main = box("article", ["article", "article-body", "post", "content", "contents", "main-content", "maincontent", "entry-content", "entry", "story", "post-body", "body-text", "text", "prose", "copy", "page-content"], ["article", "article", "main", "div", "div", "section"], main, 1)
        for _ in range(r.choice([0, 0, 1, 2])):
            main = f"<{(tag := r.choice(['div', 'main', 'section', 'div']))}{r.choice(['', ' id=page', ' class=wrapper', ' class=container', ' class=content'])} data-y=1>{noise() if r.random() < 0.3 else ''}{main}{noise() if r.random() < 0.4 else ''}</{tag}>"
        top = "".join(noise() for _ in range(r.choice([0, 1, 1, 2, 3])))
        if r.random() < 0.5:
            top = box("header", ["header", "masthead", "site-header", "top"], ["header", "header", "div"], (f"<h1 data-y=0>{_words(r, 2, False)}</h1>" if r.random() < 0.4 else "") + (links(r.randint(1, 6)) if r.random() < 0.7 else _words(r, 6)), 0) + top
        end = "".join(noise() for _ in range(r.choice([0, 0, 1, 2])))
        if r.random() < 0.75:
            end += box("footer", ["footer", "site-footer", "foot"], ["footer", "footer", "footer", "div"], ("&copy; " if r.random() < 0.6 else "") + (_words(r, r.randint(2, 30)) if r.random() < 0.6 else links(5)), 0)
        yield f"<!DOCTYPE html><html><head><title>x</title></head><body data-y=1>{top}{main}{end}</body></html>"


_LABEL = re.compile(r"data-y=([01])")


def labelled(page: str) -> tuple[list[Node], list[Block], np.ndarray]:
    """A made-up page's nodes, blocks and labels. The labels are read in the order of the start tags and then taken out."""
    order = [int(m[1]) for m in _LABEL.finditer(page)]
    nodes, blocks = parse(_LABEL.sub("", page))
    return nodes, blocks, np.array([1, 1, *order] if nodes[1:] and nodes[1].tag == "html" else [1, *order], float)


@functools.cache
def trained(pages: int = TRAIN_PAGES, seed: int = SEED) -> dict:
    """Trees and token weights from so many made-up pages. Half of the pages give the weights that the trees see on the other half, and the
    other way round: else the trees would trust tokens that stand once."""
    read = [(nodes, blocks, y) for nodes, blocks, y in map(labelled, sample_pages(pages, seed)) if len(nodes) == len(y)]
    halves = [read[::2], read[1::2]]
    x = [features(nodes, blocks, w) for own, other in (halves, halves[::-1]) for w in [token_weights([(a, y) for a, _, y in other])] for nodes, blocks, _ in own]
    model = boost(np.concatenate(x), np.concatenate([y for half in halves for _, _, y in half]))
    return model | {"weights": token_weights([(a, y) for a, _, y in read])}


def extract(pages: list[str | None], model: dict) -> list[str]:
    """The main text of each page."""
    parsed = [parse(p or "") for p in pages]
    rows = [features(*p, model["weights"]) for p in parsed]
    odds = log_odds(model, np.concatenate(rows)) if rows else np.empty(0)
    out, at = [], 0
    for (nodes, blocks), x in zip(parsed, rows, strict=True):
        kept = decode(nodes, odds[at : at + len(x)])
        at += len(x)
        texts = (" ".join("".join(t for i, t in parts if kept[i]).split()) for _, parts in blocks)
        out.append("\n".join(filter(None, texts)))
    return out


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages.

    Null and empty pages have the empty text, as have pages without any text that is kept. Pages are read whole, however
    long. Repeated rows each give a row. Other columns of pages play no part, whatever their names.
    """
    model = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                text = extract(part.column(2).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    schema = T.StructType([T.StructField("page_id", pages.schema[page_id].dataType), T.StructField("url", pages.schema[url].dataType), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html")).mapInArrow(run, schema)


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """main_text() of all pages."""
    return main_text(read(spark, sf_dir, "pages"))
