"""Main text of web pages by a tree-structured graphical model over the DOM.

Every block element is a node with a hidden label: content or not. A node
potential scores its tag, its class, id and role words, and its text; an edge
potential couples parent and child. Sum-product messages go up the tree and down
again, which is exact on a tree, and give each node's content marginal. The text
blocks of nodes over one half are the result.

The model is trained here, piecewise, on labelled pages: node potentials by
logistic regression, edge potentials by how much more often a label follows its
parent's on a kind of edge than it does anywhere. The labelled pages are drawn from
a page grammar in this module, which writes articles of many layouts with menus,
headers, footers, sidebars, notices, adverts, forms and reader comments.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import importable

# Fixed values of HTML: elements without content, with raw text, within a line, and closed by the next of their kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes".split())
_MATH = "math semantics annotation mrow mi mn mo ms mtext mspace mfrac msqrt mroot mstyle mpadded mfenced menclose msub msup msubsup munder mover munderover mtable mtr mtd"
INLINE = frozenset(f"a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr {_MATH}".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
CLOSED_BY = {
    "li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")),
    "tbody": ("tbody thead tfoot tr td th", ("table",)), "thead": ("tbody thead tfoot tr td th", ("table",)), "tfoot": ("tbody thead tfoot tr td th", ("table",)), "body": ("head", ("html",)),
}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SENTENCE = re.compile(r"[.!?:;…。]\W*$")
BUCKETS = 4096


class Page(NamedTuple):
    """Nodes, parents first, and text blocks in page order."""

    tags: list[str]
    attrs: list[str]
    parents: list[int]
    blocks: list[tuple[int, str, int]]  # node, text, characters within links


def parse(source: str) -> Page:
    """The block elements of a page and its text blocks. Any text is a page; what is open at its end is closed."""
    tags, attrs, parents, blocks = ["#page"], [""], [-1], []
    stack: list[tuple[str, int]] = [("#page", 0)]  # open elements; inline ones have their block's node
    places: dict[str, list[int]] = {"#page": [0]}  # where the open elements of each name stand in the stack
    run: list[str] = []
    links = 0
    linked = False

    def end_block() -> None:
        nonlocal links
        if run:
            text = " ".join("".join(run).split())
            if text:
                blocks.append((stack[-1][1], text, links))
            run.clear()
        links = 0

    def close(at: int) -> None:
        nonlocal linked
        if any(t not in INLINE for t, _ in stack[at:]):
            end_block()
        for t, _ in stack[at:]:
            places[t].pop()
        del stack[at:]
        linked = bool(places.get("a"))

    def last(names) -> int:
        return max([places[t][-1] for t in names if places.get(t)], default=0)

    def nearest(names, stops) -> int:
        """The innermost open element of these names, unless one of ``stops`` stands within it; 0 if none."""
        at = last(names)
        return at if at and at >= last(stops) else 0

    pos, size = 0, len(source)
    while pos < size:
        m = _TOKEN.search(source, pos)
        if (end := m.start() if m else size) > pos:
            text = entities.unescape(source[pos:end]) if "&" in source[pos:end] else source[pos:end]
            run.append(text)
            if linked:
                links += len(text)
        if not m:
            break
        pos = max(m.end(), end + 1)
        name = m[2]
        if name is None:
            if m[0].startswith("<![CDATA["):
                run.append(m[0][9:].removesuffix("]]>"))
            continue
        if m.end() == size and source[-1] != ">":
            break  # a tag that the page's end cuts
        name = name.lower()
        if m[1]:
            if places.get(name):
                at = nearest((name,), ()) if name not in INLINE else nearest((name,), CLOSES_P)
                if at:
                    close(at)
            elif name == "p":
                end_block()
            continue
        if name in RAW:
            if not m[3].rstrip().endswith("/"):
                stop = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(source, pos)
                pos = stop.end() if stop else size
            continue
        if name == "xmp":  # text as it stands, tags and all
            stop = re.compile(r"</xmp\b[^>]*(?:>|\Z)", re.I).search(source, pos)
            end_block()
            run.append(source[pos : stop.start() if stop else size])
            end_block()
            pos = stop.end() if stop else size
            continue
        if m[3].rstrip().endswith("/") and (name == "svg" or name in _MATH.split()):
            continue  # foreign elements may be closed at once
        if name in VOID:
            if name in ("br", "wbr"):
                run.append(" " if name == "br" else "")
            elif name not in INLINE:
                if name in CLOSES_P and places.get("p"):
                    close(at) if (at := nearest(("p",), ("td", "th", "button"))) else None
                end_block()
            continue
        if name in CLOSES_P and places.get("p") and (at := nearest(("p",), ("td", "th", "caption", "button"))):
            close(at)
        if name in CLOSED_BY:
            names, stops = CLOSED_BY[name]
            names = names.split()
            while at := nearest(names, stops):
                close(at)
        if name in INLINE:
            stack.append((name, stack[-1][1]))
            linked = linked or name == "a"
        else:
            end_block()
            tags.append(name)
            attrs.append(m[3])
            parents.append(stack[-1][1])
            stack.append((name, len(tags) - 1))
        places.setdefault(name, []).append(len(stack) - 1)
    end_block()
    return Page(tags, attrs, parents, blocks)


@lru_cache(maxsize=200_000)
def _bucket(word: str) -> int:
    import zlib

    return zlib.crc32(word.encode("utf-8")) % BUCKETS


@lru_cache(maxsize=50_000)
def _element(tag: str, attrs: str, place: str) -> tuple[int, ...]:
    """Features of a tag and its class, id and role words, as the node's own or an ancestor's."""
    words = {f"{place}t:{tag}"}
    for _, a, b, c in _ATTR.findall(attrs):
        words |= {f"{place}w:{w}" for w in _PART.findall(_CAMEL.sub(" ", a or b or c).lower())}
    return tuple(sorted({_bucket(w) for w in words}))


def features(page: Page) -> list[tuple[int, ...]]:
    """Buckets of each node's features: its element, its parent's and grandparent's, and its own text's size, links and form."""
    n = len(page.tags)
    chars, links, ends, marks = [0] * n, [0] * n, [0] * n, [0] * n
    for node, text, linked in page.blocks:
        chars[node] += len(text)
        links[node] += linked
        ends[node] += bool(_SENTENCE.search(text))
        marks[node] += "©" in text
    out = []
    for k in range(n):
        own, at = [], k
        for place in ("", "p", "g"):
            own += _element(page.tags[at], page.attrs[at], place)
            if (at := page.parents[at]) < 0:
                break
        if not chars[k]:
            own.append(_bucket("x:none"))
        else:
            size = min(6, int(math.log2(1 + chars[k]) / 1.6))
            own.append(_bucket(f"x:{size}"))
            own.append(_bucket(f"l:{min(4, int(5 * links[k] / chars[k]))}"))
            own.append(_bucket("e:end" if ends[k] else "e:open"))
            if marks[k]:
                own.append(_bucket("m:copyright"))
        out.append(tuple(own))
    return out


#: Elements that hold text by itself, and those around a whole page: the kinds of edges, each with its own potential.
TEXTS = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption tr tbody".split())
ROOTS = frozenset("#page html body".split())


def edge_kinds(page: Page) -> list[int]:
    """The kind of each node's edge to its parent."""
    return [(t in TEXTS) + 2 * (page.tags[p] in ROOTS) for t, p in zip(page.tags, page.parents, strict=True)]


#: Power of the edge potentials: node features know of ancestors too, and evidence should count once.
TEMPER = 0.5


class Model(NamedTuple):
    weights: list[float]  # by bucket
    intercept: float
    edges: list[tuple[float, float, float, float]]  # by kind: potentials exp() of (parent, child) = 00, 01, 10, 11


def marginals(page: Page, model: Model) -> list[float]:
    """The content probability of each node: sum-product up the tree, then down."""
    n = len(page.tags)
    w = model.weights
    belief = [model.intercept + sum([w[b] for b in f]) for f in features(page)]
    kinds = edge_kinds(page)
    up = [0.0] * n
    exp, log = math.exp, math.log
    for k in range(n - 1, 0, -1):  # children come after their parents
        p00, p01, p10, p11 = model.edges[kinds[k]]
        odds = exp(min(50.0, max(-50.0, belief[k])))
        up[k] = log((p10 + p11 * odds) / (p00 + p01 * odds))
        belief[page.parents[k]] += up[k]
    for k in range(1, n):
        p00, p01, p10, p11 = model.edges[kinds[k]]
        odds = exp(min(50.0, max(-50.0, belief[page.parents[k]] - up[k])))
        belief[k] += log((p01 + p11 * odds) / (p00 + p10 * odds))
    return [1 / (1 + exp(-min(50.0, max(-50.0, b)))) for b in belief]


def main_text(source: str | None, model: Model) -> str:
    """Blocks of content nodes, in page order, two line feeds between them."""
    if not source:
        return ""
    page = parse(source)
    content = marginals(page, model)
    return "\n\n".join(text for node, text, _ in page.blocks if content[node] >= 0.5)


# The page grammar. Class and id words of each region, as sites commonly name them (fixed values).
REGIONS = {
    "menu": "nav navbar menu navigation topnav mainnav breadcrumb breadcrumbs pagination pager tabs toc skip links submenu",
    "header": "header masthead top topbar branding logo banner sitename tagline pageheader",
    "footer": "footer foot bottom copyright legal colophon credits pagefooter imprint siteinfo",
    "sidebar": "sidebar side aside widget rail related recommended trending popular tags archive secondary right left more",
    "notice": "cookie consent notice alert gdpr popup modal overlay paywall message warning newsletter subscribe signup toast disclaimer",
    "advert": "ad ads advert advertisement adsense sponsor sponsored promo promotion banner adbox dfp outbrain taboola",
    "form": "form search login register contact feedback poll survey signin",
    "comments": "comments comment reply replies respond disqus discussion thread commentlist usercomment reader responses",
    "share": "share social sharing follow buttons meta byline toolbar print",
}
ARTICLE = "article content post entry story main body text articlebody maincontent postbody entrycontent page blog news detail prose"
TAGS = {"menu": "nav div ul nav", "header": "header div header", "footer": "footer div footer", "sidebar": "aside div section aside", "notice": "div section div dialog noscript", "advert": "div aside div ins section", "form": "form div form", "comments": "section div ol div", "share": "div ul p"}


class Grammar:
    """Draws labelled pages: HTML and whether each node, in the order of parse(), is content."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.html: list[str] = []
        self.labels: list[bool] = [False]

    def words(self, low: int, high: int) -> str:
        r = self.r
        letters = "etaoinshrdlucmfwypvbgkéüñabc"
        return " ".join("".join(r.choices(letters, k=r.randint(2, 9))) for _ in range(r.randint(low, high)))

    def sentence(self, low: int, high: int) -> str:
        return self.words(low, high).capitalize() + self.r.choice([".", ".", ".", "!", "?", ""])

    def tag(self, name: str, content: bool, names: str = "") -> str:
        r = self.r
        attrs = ""
        if names and r.random() < 0.8:
            w = r.choice(names.split())
            if r.random() < 0.4:
                w += r.choice(["-", "_", " "]) + r.choice(["wrap", "box", "area", "container", "block", "inner", "list", "main", "col", r.choice(names.split())])
            attrs = f' {r.choice(["class", "class", "id"])}="{w}"'
        self.labels.append(content)
        return f"<{name}{attrs}>"

    def put(self, name: str, content: bool, text: str, close: bool = True) -> None:
        self.html.append(self.tag(name, content) + text + (f"</{name}>" if close else ""))

    def article(self) -> None:
        r = self.r
        wrap = []
        for _ in range(r.choice([0, 1, 1, 1, 1, 2, 2, 3])):
            name = r.choice(["article", "article", "main", "div", "div", "section"])
            self.html.append(self.tag(name, True, ARTICLE if name in ("div", "section") or r.random() < 0.3 else ""))
            wrap.append(name)
        if r.random() < 0.8:
            inside = r.random() < 0.4 and bool(wrap)  # a title may stand in a header of the article's own
            if inside:
                self.html.append(self.tag("header", True, r.choice(["", "entryheader posthead articleheader title"])))
            self.put("h1", True, self.sentence(2, 14))
            if inside:
                self.html.append("</header>")
        brief = r.random() < 0.05  # verse, chat, lists of names: many short paragraphs
        for _ in range(r.choice([0, 1, 2, 3, 5, 8, 14]) if not brief else r.choice([3, 10, 25, 60])):
            kind = r.random()
            if kind < 0.72 or brief:
                inner = self.sentence(1, 4 if brief else 90)
                style = r.random()
                if style < 0.2:
                    inner = f"<b>{inner}<br>"
                elif style < 0.4:
                    inner += f' <a href="/x">{self.words(1, 3)}</a> {self.sentence(2, 30)}'
                self.put("p", True, inner, close=r.random() < 0.8)
            elif kind < 0.8:
                self.put(r.choice(["h2", "h3", "h4"]), True, self.sentence(1, 9))
            elif kind < 0.86:
                self.put(r.choice(["blockquote", "pre", "div"]), True, self.sentence(4, 50))
            elif kind < 0.89:
                name = r.choice(["ul", "ol"])
                self.html.append(self.tag(name, True))
                for _ in range(r.randint(1, 5)):
                    self.put("li", True, self.sentence(2, 25), close=r.random() < 0.7)
                self.html.append(f"</{name}>")
            elif kind < 0.91:
                self.html.append(self.tag("table", True))
                for _ in range(r.randint(1, 4)):
                    self.html.append(self.tag("tr", True))
                    for _ in range(2):
                        self.put("td", True, self.words(1, 6))
                    self.html.append("</tr>")
                self.html.append("</table>")
            elif kind < 0.93:
                self.html.append(self.tag("figure", True) + '<img src="x.jpg">')
                self.put("figcaption", True, self.sentence(3, 15))
                self.html.append("</figure>")
            else:
                self.region(r.choice(["advert", "advert", "share", "notice", "sidebar", "form", "menu"]))
        if r.random() < 0.15:
            self.region(r.choice(["comments", "share", "sidebar"]))
        if r.random() < 0.9:
            self.html += [f"</{name}>" for name in reversed(wrap)]

    def region(self, kind: str) -> None:
        r = self.r
        name = r.choice(TAGS[kind].split())
        named = name not in ("nav", "header", "footer", "aside", "form", "dialog", "ins", "noscript") or r.random() < 0.4
        opening = self.tag(name, False, REGIONS[kind] if named else "")
        if named and "=" not in opening:
            opening = f'<{name} class="{r.choice(REGIONS[kind].split())}">'
        self.html.append(opening)
        if kind in ("menu", "share"):
            inner = name
            if name not in ("ul", "p"):
                self.html.append(self.tag("ul", False))
                inner = "ul"
            for _ in range(r.randint(2, 9)):
                link = f'<a href="/{r.randint(0, 99)}">{self.words(1, 3)}</a>'
                self.put("li", False, link) if inner == "ul" else self.html.append(link + " ")
            if inner != name:
                self.html.append("</ul>")
        elif kind == "comments":
            for _ in range(r.randint(1, 5)):
                self.html.append(self.tag(r.choice(["div", "article"]), False, REGIONS[kind]))
                last = self.html[-1].split()[0].strip("<>")
                self.put(r.choice(["p", "div", "h4"]), False, self.words(1, 3))
                self.put("p", False, self.sentence(3, 60))
                self.html.append(f"</{last}>")
        elif kind == "form":
            self.put(r.choice(["p", "div", "h3"]), False, f"<label>{self.words(1, 4)}</label><input type=text>")
        else:
            if r.random() < 0.5:
                self.html.append(r.choice(["", "&copy; 2020 ", "&copy; site &middot; "] if kind == "footer" else [""]) + self.sentence(1, 30))
            for _ in range(r.randint(0, 3)):
                text = self.sentence(1, 25) if r.random() < 0.6 else f'<a href="/y">{self.words(1, 6)}</a>'
                self.put(r.choice(["p", "p", "div", "h2", "h3"]), False, text)
        self.html.append(f"</{name}>")

    def page(self) -> tuple[str, list[bool]]:
        r = self.r
        self.html.append("<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body>")
        self.labels += [False, False, False]
        outer = 0
        if r.random() < 0.3:
            self.html.append(self.tag("div", False, "page wrapper wrap container site root outer layout"))
            outer = 1
        for kind in r.sample(["header", "menu", "notice", "advert", "form", "sidebar", "share"], r.randint(0, 4)):
            self.region(kind)
        if r.random() < 0.97:
            self.article()
        for kind in r.sample(["comments", "sidebar", "advert", "footer", "form", "notice", "menu"], r.randint(0, 4)):
            self.region(kind)
        if r.random() < 0.7:
            self.region("footer")
        self.html.append("</div>" * outer + "</body></html>")
        return "".join(self.html), self.labels


def labelled_pages(seed: int, n: int) -> list[tuple[Page, list[bool], str]]:
    """Pages of the grammar; a draw whose markup leaves the intended tree is drawn anew."""
    found, k = [], 0
    while len(found) < n:
        source, labels = Grammar(seed * 1_000_003 + k).page()
        page = parse(source)
        k += 1
        if len(page.tags) == len(labels):
            found.append((page, labels, source))
    return found


def train(seed: int = 1, pages: int = 800, steps: int = 250, penalty: float = 1e-5) -> Model:
    """Fit node and edge potentials to labelled pages."""
    drawn = labelled_pages(seed, pages)
    nodes = [f for page, _, _ in drawn for f in features(page)]
    y = np.array([x for _, labels, _ in drawn for x in labels], float)
    row = np.repeat(np.arange(len(nodes)), [len(f) for f in nodes])
    col = np.array([b for f in nodes for b in f])
    w, b = np.zeros(BUCKETS), 0.0
    m, v = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for step in range(1, steps + 1):
        z = np.bincount(row, weights=w[col], minlength=len(nodes)) + b
        error = (1 / (1 + np.exp(-z)) - y) / len(nodes)
        slope = np.append(np.bincount(col, weights=error[row], minlength=BUCKETS) + penalty * w, error.sum())
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - float(move[-1])
    met = np.ones((4, 2, 2))
    for page, labels, _ in drawn:
        kinds = edge_kinds(page)
        for k in range(1, len(labels)):
            met[kinds[k], int(labels[page.parents[k]]), int(labels[k])] += 1
    edges = []
    for kind in range(4):
        usual = met[kind % 2 :: 2].sum(axis=(0, 1))  # labels of such children under any parent
        ratio = met[kind] / met[kind].sum(axis=1, keepdims=True) / (usual / usual.sum())
        edges.append(tuple((ratio**TEMPER).ravel().tolist()))
    return Model(w.tolist(), b, edges)


@lru_cache(maxsize=4)
def trained(seed: int = 1) -> Model:
    return train(seed)


def extract(pages: DataFrame, model: Model | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every row.

    Null html is empty and gives an empty text, as does a page without content.
    Null and repeated ids and urls are passed on; repeated rows give a row each. A page of
    any length is parsed as a whole, in time that grows with its length. An empty table
    gives no rows; other columns are ignored, whatever their names.
    """
    importable(pages.sparkSession)
    model = model or trained()

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        from tessera.llm.html_graph import main_text as extracted

        for batch in batches:
            texts = [extracted(h, model) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col)).mapInArrow(run, "page_id long, url string, text string, n_chars long")
