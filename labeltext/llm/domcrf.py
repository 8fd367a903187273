"""Main-text extraction with a tree-structured graphical model of the DOM.

Every block element is a node with a hidden label, content or not. Unary
potentials come from the node's own features (element, words in its class, id
and role, length, links, punctuation); each edge has a potential over the labels
of parent and child, which depends on the child's kind. Sum-product messages go up the tree and
down again, which gives each node's exact probability of being content. The
weights maximise the likelihood of labelled pages, generated here in many
layouts (with and without telling elements and class names).

The text of the blocks with a probability of at least one half, in page order, is
the main text. Scripts, styles and other elements without text of the page have no nodes.
"""

from __future__ import annotations

import functools
import math
import random
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labeltext.llm.bytetext import bounded_batches, released

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template head title svg math iframe object canvas textarea select option datalist".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var br img wbr input".split()
)
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Start tags that leave an open head open.
IN_HEAD = frozenset("html base basefont bgsound link meta title style script noscript noframes template".split())
#: Hidden elements that the end tag of an element around them ends as well.
SOFT = frozenset("head svg math canvas option datalist".split())
#: Start tags that end an open svg or math, unless it holds an element that may hold html.
BREAKS_OUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 hr i img li menu nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
HOLDS_HTML = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
#: An element that one of these begins also ends, if it is the nearest open one.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

TAGS = "article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table tr td th figure figcaption nav header footer aside form button fieldset menu address dialog body html details".split()
#: Words in class, id, role and the like; fixed lists.
WORDS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc tabs pager pagination sitemap",
    "edge": "header footer masthead banner topbar bottom copyright legal contentinfo colophon",
    "side": "sidebar side aside widget related rail recommended popular trending complementary promo teaser",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay notification paywall disclaimer warning",
    "advert": "ad ads adv advert adverts advertisement sponsor sponsored sponsors banner-ad adbox promoted dfp",
    "comment": "comment comments reply replies respond discussion disqus feedback thread",
    "form": "form search login signup subscribe newsletter share social sharing follow button",
    "main": "content article post main entry story text body-text maincontent prose",
}
KIND = {t: k for k, ts in (("box", "article main section div body html figure details"), ("text", "p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th tr table ul ol dl figcaption"), ("rim", "nav header footer aside form button fieldset menu address dialog")) for t in ts.split()}
KINDS = ("box", "text", "rim")
N_UNARY = len(TAGS) + 1 + len(WORDS) + 12


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "runs", "own", "linked", "inside", "order")

    def __init__(self, tag: str, attrs: list, parent: int) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[int] = []
        self.own = self.linked = 0


class Builder(HTMLParser):
    """DOM of the block elements, and the text runs with the block they are in."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("html", [], -1)]
        self.runs: list[tuple[int, list[str]]] = []
        self.open: list[tuple[str, int]] = [("html", 0)]  # element, block node that text goes to
        self.hidden = 0  # place in ``open`` of the outermost element without text of the page, or 0
        self.links = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.hidden:
            self._imply(tag)
        if tag in ("html", "body"):
            self.nodes[0].attrs = self.nodes[0].attrs + attrs
            return
        if tag == "head" and len(self.open) > 1:
            return  # a head within the page is no element
        if self.hidden or tag in HIDDEN:
            if tag not in VOID:
                self.hidden = self.hidden or len(self.open)
                self.links += tag == "a"
                self.open.append((tag, self.open[-1][1]))
            return
        if tag in INLINE or tag in VOID:
            if tag in ("br", "hr", "img", "wbr"):
                self._text(" " if tag != "wbr" else "")
            if tag not in VOID:
                self.links += tag == "a"
                self.open.append((tag, self.open[-1][1]))
            return
        if tag in CLOSES_P:
            self._close("p", stop=("td", "th", "li", "div", "article", "section", "main", "aside", "form", "blockquote"))
        for other in SIBLINGS.get(tag, ()):
            self._close(other, stop=("ul", "ol", "dl", "table"))
        self.nodes.append(Node(tag, attrs, self.open[-1][1]))
        self.nodes[self.open[-1][1]].children.append(len(self.nodes) - 1)
        self.open.append((tag, len(self.nodes) - 1))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and (tag in INLINE or tag in HIDDEN or self.hidden):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body"):
            if self.open[-1][0] == "head":
                self._end(self.hidden)
        elif tag != "br":
            self._close(tag)
        elif not self.hidden:
            self._text(" ")

    def _imply(self, tag: str) -> None:
        """Ends the open hidden elements that the start tag ``tag`` cannot be in."""
        outer = self.open[self.hidden][0]
        within = [n for n, _ in self.open[self.hidden :]] if tag in BREAKS_OUT else []
        if outer == "head":
            if self.open[-1][0] == "head" and tag not in IN_HEAD or tag == "body" and "template" not in within:
                self._end(self.hidden)
        elif outer in ("svg", "math"):
            if within and HOLDS_HTML.isdisjoint(within):
                self._end(self.hidden)
        elif outer == "option" and tag not in INLINE and tag not in VOID and tag not in HIDDEN:
            self._end(self.hidden)  # one without a select
        if not self.hidden:
            return
        if tag in ("select", "input", "textarea"):
            self._close("select", stop=("template",))
        for other in SIBLINGS.get(tag, ()) if tag in HIDDEN else ():
            self._close(other, stop=("select", "datalist"))

    def _end(self, k: int) -> None:
        self.links -= sum(n == "a" for n, _ in self.open[k:])
        del self.open[k:]
        if k <= self.hidden:
            self.hidden = 0

    def _close(self, tag: str, stop: tuple[str, ...] = ()) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            name = self.open[k][0]
            if name == tag:
                self._end(k)
                return
            if name in stop:
                return
            if self.hidden and k >= self.hidden:
                if k == self.hidden and name not in SOFT:
                    return
            elif tag in INLINE and name not in INLINE:
                return  # an inline end tag does not close a block

    def _text(self, data: str) -> None:
        at = self.open[-1][1]
        if self.runs and self.runs[-1][0] == at:
            self.runs[-1][1].append(data)
        else:
            self.runs.append((at, [data]))

    def handle_data(self, data: str) -> None:
        if self.open[-1][0] == "head" and data.strip(" \t\n\r\f"):
            self._end(self.hidden)
        if not self.hidden:
            self._text(data)
            size = len(data) - data.count(" ")
            node = self.nodes[self.open[-1][1]]
            node.own += size
            node.linked += size * (self.links > 0)


def parse(html: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """(nodes, text runs (node, text) with white space joined, none empty). A
    run is what a block holds between two of its child blocks."""
    builder = Builder()
    cut = html.rfind("<")
    if cut >= 0 and html.find(">", cut) < 0 and html[cut + 1 : cut + 2] and (html[cut + 1].isalpha() or html[cut + 1] in "/!?"):
        html = html[:cut]  # the page ends within a tag
    builder.feed(html)
    builder.close()
    joined = ((n, " ".join("".join(parts).split())) for n, parts in builder.runs)
    return builder.nodes, [(n, t) for n, t in joined if t]


_SPLIT = re.compile(r"[A-Za-z]+")
_LEXICON = {w: k for k, ws in enumerate(WORDS.values()) for w in ws.split()}


def unary(nodes: list[Node], runs: list[tuple[int, str]]) -> np.ndarray:
    """Feature matrix (nodes x N_UNARY)."""
    x = np.zeros((len(nodes), N_UNARY))
    stops, words = [0] * len(nodes), [0] * len(nodes)
    for n, t in runs:
        stops[n] += t.count(".") + t.count(",")
        words[n] += t.count(" ") + 1
    size, linked, total = [n.own for n in nodes], [n.linked for n in nodes], max(1, sum(n.own for n in nodes))
    for i in range(len(nodes) - 1, 0, -1):
        size[nodes[i].parent] += size[i]
        linked[nodes[i].parent] += linked[i]
    base = len(TAGS) + 1
    for i, n in enumerate(nodes):
        x[i, TAGS.index(n.tag) if n.tag in TAGS else len(TAGS)] = 1
        for name, value in n.attrs:
            if name in ("class", "id", "role", "aria-label", "itemprop") and value:
                for w in _SPLIT.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value)):
                    if (k := _LEXICON.get(w.lower())) is not None:
                        x[i, base + k] = 1
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and re.search(r"display\s*:\s*none", value):
                x[i, base + len(WORDS) + 11] = 1
        f = x[i, base + len(WORDS) :]
        f[0] = 1
        f[1] = n.own > 0
        f[2] = min(1.0, words[i] / 20)
        f[3] = linked[i] / size[i] if size[i] else 0
        f[4] = n.own > 0 and n.linked == n.own
        f[5] = min(1.0, stops[i] / 3)
        f[6] = size[i] / total
        f[7] = not n.children
        f[8] = words[i] > 0 and words[i] <= 4
        f[9] = i == 0
        f[10] = size[i] == 0
    return x


class Weights:
    def __init__(self) -> None:
        self.unary = np.zeros(N_UNARY)  # log-odds of content
        self.edge = np.zeros((len(KINDS) + 1, 2, 2))  # by the child's kind, parent's and child's label
        for k in range(len(KINDS) + 1):
            self.edge[k] = [[0.5, -0.5], [-0.5, 0.5]]


def _kind(node: Node) -> int:
    return KINDS.index(KIND[node.tag]) if node.tag in KIND else len(KINDS)


def marginals(nodes: list[Node], x: np.ndarray, w: Weights) -> tuple[list[float], list[list[list[float]]]]:
    """(probability of content per node, joint of the parent's and the node's
    label per node) by messages from the leaves to the root and back. Parents
    come before their children in ``nodes``. Log space, two labels."""
    n = len(nodes)
    score = (x @ w.unary).tolist()
    edge = w.edge.tolist()
    kind = [_kind(v) for v in nodes]

    def lse(a: float, b: float) -> float:
        m = a if a > b else b
        return m + math.log(math.exp(a - m) + math.exp(b - m))

    up = [[0.0, 0.0] for _ in range(n)]  # message to the parent, by its label
    below = [[0.0, score[i]] for i in range(n)]
    for i in range(n - 1, 0, -1):
        e, b = edge[kind[i]], below[i]
        up[i] = [lse(e[0][0] + b[0], e[0][1] + b[1]), lse(e[1][0] + b[0], e[1][1] + b[1])]
        p = below[nodes[i].parent]
        p[0] += up[i][0]
        p[1] += up[i][1]
    belief = [list(b) for b in below]
    joint: list[list[list[float]]] = [[[0.0, 0.0], [0.0, 0.0]]] * n
    prob = [0.0] * n
    for i in range(n):
        if i:
            p, e = nodes[i].parent, edge[kind[i]]
            rest = [belief[p][0] - up[i][0], belief[p][1] - up[i][1]]
            down = [lse(rest[0] + e[0][0], rest[1] + e[1][0]), lse(rest[0] + e[0][1], rest[1] + e[1][1])]
            belief[i] = [below[i][0] + down[0], below[i][1] + down[1]]
            z = lse(belief[i][0], belief[i][1])
            joint[i] = [[math.exp(rest[a] + e[a][b] + below[i][b] - z) for b in (0, 1)] for a in (0, 1)]
        z = lse(belief[i][0], belief[i][1])
        prob[i] = math.exp(belief[i][1] - z)
    return prob, joint


# Labelled pages, generated.


def labelled_page(r: random.Random) -> str:
    """A page in which content blocks carry the attribute ``data-y``."""
    word = lambda: "".join(r.choice("aeinorst dlhu".replace(" ", "")) for _ in range(r.randint(2, 9)))
    text = lambda a, b: " ".join(word() + r.choice(["", "", "", "", ",", "."]) for _ in range(r.randint(a, b)))
    link = lambda a=1, b=2: f'<a href="/{word()}">{text(a, b)}</a>'
    plain = r.random() < 0.25  # a page without telling names

    def wrap(tag: str, names: str, inner: str, y: bool = False) -> str:
        if r.random() < 0.35:
            tag = "div"
        attr = f' {r.choice(["class", "class", "id"])}="{r.choice(names.split())}"' if names and not plain and (tag == "div" or r.random() < 0.4) else ""
        return f"<{tag}{attr}{' data-y' if y else ''}>{inner}</{tag}>"

    def items(a: int, b: int) -> str:
        return "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(r.randint(a, b))) + "</ul>"

    def para() -> str:
        inner = text(8, 60)
        if r.random() < 0.3:
            inner = f"<b>{text(2, 6)}</b> {inner}"
        if r.random() < 0.25:
            inner += f" {link(1, 3)} {text(3, 9)}"
        return f"<p data-y>{inner if r.random() < 0.85 else text(1, 5)}</p>"

    def block() -> str:
        k = r.random()
        if k < 0.72:
            return para()
        if k < 0.8:
            return f"<h{r.randint(2, 4)} data-y>{text(2, 7)}</h2>".replace("</h2>", "</h2>")
        if k < 0.87:
            return "<ul data-y>" + "".join(f"<li data-y>{text(3, 15)}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
        if k < 0.92:
            return f"<blockquote data-y>{text(8, 30)}</blockquote>"
        if k < 0.96:
            return f"<pre data-y>{text(4, 20)}</pre>"
        return "<table data-y>" + "".join(f"<tr data-y><td data-y>{text(1, 4)}</td><td data-y>{text(1, 4)}</td></tr>" for _ in range(r.randint(1, 3))) + "</table>"

    def advert() -> str:
        return wrap(r.choice(["div", "aside"]), WORDS["advert"] if not plain else "", r.choice([text(3, 14), link(2, 6), f"<p>{text(3, 12)}</p>"]))

    inner = [f"<h1 data-y>{text(2, 12)}</h1>"] + [block() for _ in range(r.randint(1, 9))]
    if r.random() < 0.3:
        inner.insert(r.randint(1, len(inner)), f'<div class="{r.choice(WORDS["advert"].split())}">{text(3, 14)}</div>')
    if r.random() < 0.15:
        inner.append(f'<aside class="{r.choice(WORDS["side"].split())}">{items(2, 4)}</aside>')
    body = "".join(inner)
    tag = r.choice(["article", "article", "main", "div", "section"])
    body = f"<{tag} data-y{'' if tag != 'div' and r.random() < 0.6 or plain else f' class={chr(34)}{r.choice(WORDS["main"].split())}{chr(34)}'}>{body}</{tag}>"
    if r.random() < 0.25 and tag != "main":
        body = f"<main data-y>{body}</main>"
    top, bottom = [], []
    if r.random() < 0.5:
        top.append(wrap("header", WORDS["edge"], r.choice([f"<h2>{text(1, 3)}</h2>", link(), text(1, 4)]) + (items(2, 5) if r.random() < 0.4 else "")))
    if r.random() < 0.85:
        top.append(wrap("nav", WORDS["menu"], items(3, 8) if r.random() < 0.8 else " | ".join(link() for _ in range(5))))
    if r.random() < 0.35:
        top.append(f'<div class="{r.choice(WORDS["notice"].split())}"><p>{text(4, 25)}</p><button>{text(1, 2)}</button></div>')
    if r.random() < 0.5:
        top.append(f'<div class="{r.choice(WORDS["advert"].split())}">{text(3, 14)}</div>')
    if r.random() < 0.35:
        r.choice([top, bottom]).append(wrap("aside", WORDS["side"], r.choice([items(2, 6), f"<p>{text(5, 30)}</p>", f"<h3>{text(1, 3)}</h3>" + items(2, 4)])))
    if r.random() < 0.35:
        one = lambda: f'<div class="{r.choice(["comment", "reply", "comment-body"])}"><p>{text(3, 40)}</p></div>'
        bottom.append(f'<{(t := r.choice(["section", "div"]))} {r.choice(["class", "id"])}="{r.choice(["comments", "discussion", "replies", "respond"])}">' + "".join(one() for _ in range(r.randint(1, 4))) + f"</{t}>")
    if r.random() < 0.35:
        bottom.append(f'<form{r.choice(["", chr(32) + "class=" + chr(34) + "subscribe" + chr(34)])}><label>{text(1, 4)}</label><input type="text"><p>{text(2, 10)}</p><button>{text(1, 2)}</button></form>')
    if r.random() < 0.3:
        bottom.append(advert())
    if r.random() < 0.85:
        bottom.append(wrap("footer", WORDS["edge"], r.choice([f"&copy; {word()}.com &middot; {text(3, 18)}", f"<p>&copy; {text(3, 18)}</p>", items(2, 4) + text(2, 6)])))
    r.shuffle(top)
    return "<html><head><title>x</title></head><body>" + "".join(top) + body + "".join(bottom) + "</body></html>"


@functools.lru_cache(maxsize=1)
def fitted(pages: int = 220, epochs: int = 25, rate: float = 0.25, seed: int = 3) -> Weights:
    """Weights that maximise the likelihood of ``pages`` generated pages: observed
    minus expected features (from the marginals), by Adagrad, page by page."""
    r = random.Random(seed)
    cases = []
    for _ in range(pages):
        nodes, runs = parse(labelled_page(r))
        gold = [float(any(a == "data-y" for a, _ in n.attrs)) for n in nodes]
        gold[0] = float(any(gold))
        cases.append((nodes, unary(nodes, runs), gold))
    w, seen_u, seen_e = Weights(), np.full(N_UNARY, 1e-4), np.full((len(KINDS) + 1, 2, 2), 1e-4)
    for _ in range(epochs):
        r.shuffle(cases)
        for nodes, x, gold in cases:
            prob, joint = marginals(nodes, x, w)
            g = x.T @ (np.array(gold) - np.array(prob)) - 2e-3 * w.unary
            ge = -2e-3 * w.edge
            for i in range(1, len(nodes)):
                k, a, b = _kind(nodes[i]), int(gold[nodes[i].parent]), int(gold[i])
                ge[k] -= joint[i]
                ge[k, a, b] += 1
            seen_u += g * g
            seen_e += ge * ge
            w.unary += rate * g / np.sqrt(seen_u)
            w.edge += rate * ge / np.sqrt(seen_e)
    return w


def main_text(html: str | None, w: Weights) -> str:
    """The main text of a page; empty for null, empty or textless html."""
    if not html:
        return ""
    nodes, runs = parse(html)
    if not runs:
        return ""
    prob, _ = marginals(nodes, unary(nodes, runs), w)
    return " ".join(t for n, t in runs if prob[n] >= 0.5)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html).

    Other columns are ignored. Null or empty html, and pages without any
    content, have an empty text. Broken markup is read as far as it goes: end
    tags that are missing are implied, stray ones ignored. Repeated rows are equal; an
    empty table gives no rows. A page is handled whole, one at a time.
    """
    bounded_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(fitted())  # some hundred floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in released(batches):
            texts = [main_text(h, w) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
