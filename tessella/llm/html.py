"""op5: main text of web pages by gradient-boosted trees over DOM nodes.

A page is parsed into a tree of block elements; scripts, styles and the head never count. Each block has features: its own and its
ancestors' tag and attribute tokens, the density of text, links and sentences in its subtree, depth, and statistics of its
siblings. Boosted trees give the odds that it is main text. The decoding takes the whole tree: a block is kept, dropped, or leaves the choice
to its children; a dropped block has no kept descendant and a kept one no dropped descendant, and the best total of odds wins.

The trees are trained here, on pages that ``synthetic_page`` writes from a seed, in many layouts whose parts are known; no page of the input is used.
Null pages and pages without main text give the empty string. Choices of equal worth drop the block. Attributes of any form, repeated or
broken, are read as far as they are class, id or role and otherwise ignored. Repeated rows are extracted each; other columns are
dropped; an empty table gives no rows.
"""

from __future__ import annotations

import html as _html
import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, tidied

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_ATTR = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_MARK = re.compile(r"(?<![\w-])data-y=\"([01])\"")
_PART = re.compile(r"[A-Za-z][a-z]*|[0-9]+")
_END = re.compile(r"[.!?…](?:\s|$)")
_SPACE = re.compile(r"\s+")
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption legend button select textarea option".split())
RAW = frozenset("script style template noscript svg iframe object math audio video canvas head title textarea select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
GROUPS = (("article",), ("main",), ("section",), ("div",), ("p", "pre", "blockquote"), ("h1",), ("h2", "h3", "h4", "h5", "h6"), ("ul", "ol", "dl", "menu"), ("li", "dd", "dt"), ("nav",), ("header",), ("footer",), ("aside",), ("form", "fieldset", "button", "legend"), ("table", "tbody", "thead", "tr", "td", "th"), ("figure", "figcaption"), ("body", "html"))
GROUP_OF = {t: i for i, g in enumerate(GROUPS) for t in g}
GOOD = frozenset("article content main post story entry body text prose page hentry".split())
BAD_SETS = tuple(frozenset(x.split()) for x in ("nav navigation menu navbar breadcrumb breadcrumbs links pager pagination toolbar", "header masthead top banner logo", "footer foot copyright bottom legal", "sidebar side aside widget rail related recommended trending popular", "ad ads advert advertisement adverts sponsor sponsored promo promotion", "cookie cookies notice consent gdpr alert warning popup modal overlay message", "comment comments reply replies discussion disqus respond reader feedback", "form login search subscribe newsletter signup share social"))


class Node:
    __slots__ = ("tag", "tokens", "parent", "parts", "kids", "y", "links", "linked", "own", "size", "under", "depth", "place", "x")

    def __init__(self, tag, tokens, parent, y):
        self.tag, self.tokens, self.parent, self.y = tag, tokens, parent, y
        self.parts: list = []  # text and child blocks, in order
        self.kids: list = []
        self.links = self.linked = self.own = 0
        self.depth = parent.depth + 1 if parent else 0


def parse(page: str, marked: bool = False) -> list[Node]:
    """The blocks of a page in order; the first is the root. Unclosed and stray tags are taken as browsers mostly do. marked: the page is
    one of synthetic_page's, whose blocks say in an attribute whether they are main text."""
    root = Node("html", (), None, None)
    nodes, at, here, anchor = [root], 0, root, 0
    skip = None
    n = len(page)
    low = page.replace("\u0130", "_").lower()  # the one character whose lower case is longer
    closing: dict[str, int] = {}  # where the next closing tag of a name is, -1: nowhere
    while at < n:
        m = _TOKEN.search(page, at)
        stop = m.start() if m else n
        if stop > at and skip is None:
            text = page[at:stop]
            here.parts.append(text)
            size = len(text)
            here.own += size
            if anchor:
                here.linked += size
        if not m:
            break
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if name == skip:
                skip = None
            elif name == "a":
                anchor = max(0, anchor - 1)
            elif name in BLOCKS and skip is None:
                up = here
                while up is not root and up.tag != name:
                    up = up.parent
                if up is not root:
                    here = up.parent
                    anchor = 0
            continue
        if skip is not None:
            continue
        if name in RAW:
            end = closing.get(name, 0)
            if 0 <= end < at:
                end = closing[name] = low.find(f"</{name}", at)
            if name in ("script", "style", "title", "textarea") or end >= 0:
                end = end if name in ("script", "style", "textarea", "title") else -1
                if end >= 0:
                    close = page.find(">", end)
                    at = n if close < 0 else close + 1
                elif name in ("script", "style"):
                    at = n
                else:
                    skip = name
            continue
        if name == "body":
            continue
        if name == "br" or name == "hr":
            here.parts.append(" ")
        if name == "a":
            here.links += 1
            anchor += 1
        if name in BLOCKS and name not in VOID and name != "html":
            anchor = 0
            if name in CLOSES:
                up = here
                while up is not root and up.tag not in CLOSES[name] and up.tag not in ("ul", "ol", "dl", "table", "div", "section", "article"):
                    up = up.parent
                if up is not root and up.tag in CLOSES[name]:
                    here = up.parent
            up = here
            while up is not root and up.tag not in ("p", "li", "td", "th", "div", "section", "article", "blockquote", "dd", "table", "form", "aside", "nav"):
                up = up.parent
            if up is not root and up.tag == "p":
                here = up.parent
            tokens, y = (), None
            if m[3] and not m[3].isspace():
                own = []
                for a in _ATTR.finditer(m[3]):
                    v = a[2] or a[3] or a[4] or ""
                    own += [w.lower() for w in _PART.findall(v)]
                tokens = tuple(own)
                if marked and (mark := _MARK.search(m[3])):
                    y = int(mark[1])
            node = Node(name, tokens, here, y if y is not None else here.y)
            here.parts.append(node)
            here.kids.append(node)
            nodes.append(node)
            here = node
    return nodes


FEATURES = len(GROUPS) * 2 + 2 * (1 + len(BAD_SETS)) + 15


def features(nodes: list[Node]) -> np.ndarray:
    """One row for each block."""
    total = {}
    for v in reversed(nodes):
        t, lt, ln, ends, ps, blocks = len(_SPACE.sub("", "".join(p for p in v.parts if isinstance(p, str)))) if v.own else 0, v.linked, v.links, 0, 1 if v.tag == "p" else 0, 1
        if v.own:
            ends = sum(len(_END.findall(p)) for p in v.parts if isinstance(p, str))
        for k in v.kids:
            a = total[k]
            t, lt, ln, ends, ps, blocks = t + a[0], lt + a[1], ln + a[2], ends + a[3], ps + a[4], blocks + a[5]
        total[v] = (t, lt, ln, ends, ps, blocks)
    page = max(1, total[nodes[0]][0])
    out = np.zeros((len(nodes), FEATURES), np.float32)
    flags: dict[Node, list[float]] = {}
    g = len(GROUPS)
    for i, v in enumerate(nodes):
        x = out[i]
        t, lt, ln, ends, ps, blocks = total[v]
        k = GROUP_OF.get(v.tag)
        if k is not None:
            x[k] = 1
        own = [float(any(w in GOOD for w in v.tokens)) if v.tokens else 0.0]
        own += [float(any(w in s for w in v.tokens)) if v.tokens else 0.0 for s in BAD_SETS]
        up = flags.get(v.parent)
        base = 2 * g
        x[base : base + 9] = own
        if v.parent is not None:
            pk = [0.0] * g
            if up:
                x[base + 9 : base + 18] = up[:9]
                pk = up[9:]
            x[g : 2 * g] = pk
            tag = [max(a, float(k == j)) for j, a in enumerate(pk)]
            flags[v] = [max(a, b) for a, b in zip(own, up[:9] if up else [0.0] * 9)] + tag
        else:
            flags[v] = [0.0] * (9 + g)
        a = base + 18
        brothers = v.parent.kids if v.parent else [v]
        x[a] = math.log1p(t)
        x[a + 1] = min(1.0, lt / max(1, t))
        x[a + 2] = ln / (1 + t / 80)
        x[a + 3] = 100 * ends / max(40, t)
        x[a + 4] = math.log1p(ps)
        x[a + 5] = t / max(1, blocks)
        x[a + 6] = v.depth
        x[a + 7] = t / page
        x[a + 8] = math.log1p(len(brothers))
        x[a + 9] = t / max(1, total[v.parent][0]) if v.parent else 1.0
        x[a + 10] = math.log1p(len(v.kids))
        x[a + 11] = math.log1p(v.own)
    for v in nodes:  # statistics of siblings, by parent
        n = len(v.kids)
        if n:
            sizes = [total[k][0] for k in v.kids]
            mean = sum(sizes) / n
            for j, k in enumerate(v.kids):
                k.place = (j / max(1, n - 1), sizes[j] / max(1.0, mean), math.log1p(mean))
    for i, v in enumerate(nodes[1:], 1):
        out[i, -3:] = v.place
    return out


class Trees:
    """Boosted regression trees for a logistic loss, with binned features; plain numpy."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, least: float = 4.0):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> "Trees":
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        code = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
        share = np.average(y, weights=w)
        self.base = float(np.log(share / (1 - share)))
        f = np.full(len(y), self.base)
        size = 2**self.depth
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = w * (p - y), w * p * (1 - p)
            where = np.ones(len(y), np.int64)
            feature, cut, value = np.full(size, -1), np.zeros(size), np.zeros(2 * size)
            for node in range(1, size):
                own = np.flatnonzero(where == node)
                if len(own) < 8:
                    continue
                gs, hs = g[own].sum(), h[own].sum()
                best = (1e-6, -1, 0.0)
                for k, c in enumerate(cuts):
                    if not len(c):
                        continue
                    b = code[own, k]
                    gl = np.cumsum(np.bincount(b, g[own], len(c) + 1))[:-1]
                    hl = np.cumsum(np.bincount(b, h[own], len(c) + 1))[:-1]
                    gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                    gain[(hl < self.least) | (hs - hl < self.least)] = -1
                    j = int(gain.argmax())
                    if gain[j] > best[0]:
                        best = (float(gain[j]), k, float(c[j]))
                if best[1] >= 0:
                    feature[node], cut[node] = best[1], best[2]
                    where[own] = 2 * node + (x[own, best[1]] > best[2])
            for leaf in range(1, 2 * size):
                own = where == leaf
                if own.any():
                    value[leaf] = -self.rate * g[own].sum() / (h[own].sum() + 1)
            self.trees.append((feature, cut, value))
            f = f + value[where]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            where = np.ones(len(x), np.int64)
            for _ in range(self.depth):
                live = where < len(feature)
                f = np.where(live, feature[np.where(live, where, 0)], -1)
                go = f >= 0
                where = np.where(go, 2 * where + (x[rows, np.maximum(f, 0)] > cut[np.where(live, where, 0)]), where)
            out += value[where]
        return out


def decode(nodes: list[Node], odds: np.ndarray) -> set[Node]:
    """The blocks whose own text is main text: the consistent choice of keep, drop or mixed with the best total."""
    at = {v: i for i, v in enumerate(nodes)}
    keep, best, choice = {}, {}, {}
    for v in reversed(nodes):
        o = float(odds[at[v]])
        weight = 0.3 + min(3.0, math.log1p(v.own) / 2) if v.own else 0.15
        own = weight * o
        k = own + sum(keep[c] for c in v.kids)
        mixed = (abs(own) if v.own > 40 else 0.0) + sum(best[c] for c in v.kids) - 0.5
        keep[v] = k
        if v.kids and mixed > abs(k):
            best[v], choice[v] = mixed, "mixed"
        else:
            best[v], choice[v] = abs(k), "keep" if k > 0 else "drop"
    out: set[Node] = set()
    state = {}
    for v in nodes:
        up = state.get(v.parent, "mixed")
        state[v] = choice[v] if up == "mixed" else up
        if state[v] == "keep" or (state[v] == "mixed" and v.parent is not None and odds[at[v]] > 0):
            out.add(v)
    return out


def text_of(nodes: list[Node], kept: set[Node]) -> str:
    """The kept blocks' text, references decoded, white space made one space, in page order."""
    blocks: list[str] = []
    run: list[str] = []

    def flush():
        t = _SPACE.sub(" ", _html.unescape("".join(run))).strip()
        if t:
            blocks.append(t)
        run.clear()

    stack = [(nodes[0], iter(nodes[0].parts))]
    while stack:
        v, parts = stack[-1]
        for p in parts:
            if isinstance(p, str):
                if v in kept:
                    run.append(p)
            else:
                flush()
                stack.append((p, iter(p.parts)))
                break
        else:
            flush()
            stack.pop()
    return " ".join(blocks)


def _words(r: random.Random, n: int) -> str:
    parts = "ba de fi go lu mar nen sol tir vek wan zon pre con ter ist al ou é ñ ü th er".split()
    out, k = [], 0
    while k < n:
        m = min(n - k, r.randint(3, 14))
        s = ["".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(m)]
        out.append(" ".join(s).capitalize() + r.choice([".", ".", ".", "!", "?"]))
        k += m
    return " ".join(out)


def synthetic_page(r: random.Random) -> str:
    """A page whose blocks carry data-y: 1 main text, 0 not."""

    def el(tag, inner, y=None, cls=None):
        a = f' data-y="{y}"' if y is not None else ""
        if cls:
            a += f' {r.choice(["class", "class", "id"])}="{cls}"'
        return f"<{tag}{a}>{inner}" + ("" if tag in ("p", "li") and r.random() < 0.2 else f"</{tag}>")

    def links(n):
        return "".join(r.choice(["<li>%s</li>", "<li>%s", "%s "]) % f'<a href="/x">{_words(r, r.randint(1, 3))[:-1]}</a>' for _ in range(n))

    def prose(n=None):
        t = _words(r, n or r.choice([1, 2, 6, 20, 40, 90, 160]))
        if r.random() < 0.2:
            t = f"<{r.choice(['b', 'i', 'em', 'strong'])}>{t}" + r.choice(["", "</b>"])
        if r.random() < 0.2:
            t += f' <a href="/y">{_words(r, 2)}</a> {_words(r, 5)}'
        if r.random() < 0.2:
            t += "<br>"
        return t

    def junk(kind):
        small = r.random() < 0.7
        t = _words(r, r.randint(2, 12) if small else r.randint(12, 70))
        if kind == "nav":
            return el(r.choice(["nav", "nav", "div", "ul"]), f"<ul>{links(r.randint(2, 12))}</ul>", 0, r.choice([None, "menu", "nav main-nav", "breadcrumb", "navbar"]))
        if kind == "header":
            return el(r.choice(["header", "div"]), el(r.choice(["h1", "p", "div"]), t) + r.choice(["", f"<ul>{links(3)}</ul>"]), 0, r.choice(["header", "masthead", "site-header", "top-bar", None]) or "banner")
        if kind == "footer":
            return el(r.choice(["footer", "footer", "div"]), r.choice(["&copy; ", "", "<p>"]) + t + links(r.randint(0, 4)), 0, r.choice(["footer", "site-footer", "copyright", "footer-legal"]))
        if kind == "side":
            return el(r.choice(["aside", "div", "section"]), el("h3", _words(r, 2)) + r.choice([f"<ul>{links(5)}</ul>", el("p", t)]), 0, r.choice(["sidebar", "related", "widget", "side-rail", "trending"]))
        if kind == "ad":
            return el(r.choice(["div", "div", "aside", "section"]), r.choice([t, el("p", t), f'<a href="/ad">{t}</a>']), 0, r.choice(["ad", "ads", "advert", "ad-slot", "promo", "sponsored", "advertisement"]))
        if kind == "notice":
            return el(r.choice(["div", "section", "aside"]), el("p", t) + r.choice(["", "<button>OK</button>"]), 0, r.choice(["cookie", "cookie-notice", "notice", "consent", "alert", "popup", "gdpr"]))
        if kind == "form":
            return el("form", r.choice(["", f"<label>{_words(r, 2)}</label>"]) + el("p", t) + '<input name="q"><button>Go</button>', 0, r.choice(["search", "newsletter", "login", "subscribe", None]))
        own = "".join(el(r.choice(["div", "li", "article", "p"]), r.choice([el("p", _words(r, r.randint(3, 60))), _words(r, r.randint(3, 40))]), None, r.choice(["comment", "comment-body", "reply", None])) for _ in range(r.randint(1, 8)))
        return el(r.choice(["section", "div", "ol", "aside"]), el("h2", _words(r, 1)) + own, 0, r.choice(["comments", "comments", "discussion", "reader-comments", "respond"]))

    kinds = ["nav", "header", "footer", "side", "ad", "notice", "form", "comments"]
    body = []
    if r.random() < 0.9:
        body.append(el("h1", _words(r, r.randint(2, 10))[:-1]))
    for _ in range(r.choice([1, 1, 2, 3, 5, 8, 14])):
        k = r.random()
        if k < 0.75:
            body.append(el("p", prose()))
        elif k < 0.82:
            body.append(el(r.choice(["h2", "h3"]), _words(r, r.randint(1, 6))[:-1]))
        elif k < 0.88:
            body.append(el(r.choice(["ul", "ol"]), "".join(el("li", prose(r.choice([3, 8, 20]))) for _ in range(r.randint(2, 5)))))
        elif k < 0.93:
            body.append(el("blockquote", el("p", prose(20))))
        elif k < 0.96:
            body.append(el("div", prose()))
        else:
            body.append(junk(r.choice(["ad", "side", "form", "notice", "ad"])))
    inner = "".join(body)
    form = r.random()
    if form < 0.6:
        main = el("article", inner, 1, r.choice([None, None, "post", "story", "entry"]))
    elif form < 0.75:
        main = el("main", r.choice([inner, el("div", inner)]), 1)
    else:
        main = el(r.choice(["div", "section"]), inner, 1, r.choice(["content", "main-content", "post-body", "article-text", "entry-content", "story"]))
    if r.random() < 0.25:
        main = el(r.choice(["div", "main", "section"]), main + (junk("comments") if r.random() < 0.4 else ""), None, r.choice(["page", "wrapper", "container", "content"]))
    before = "".join(junk(r.choice(["nav", "header", "ad", "notice", "nav", "side", "form"])) for _ in range(r.randint(0, 4)))
    after = "".join(junk(r.choice(["footer", "footer", "side", "comments", "form", "ad", "nav", "notice"])) for _ in range(r.randint(0, 4)))
    page = f"<html><head><title>x</title><style>p{{}}</style></head><body>{before}{main}{after}"
    return page if r.random() < 0.1 else page + "</body></html>"


_MODEL: list[Trees] = []


def train(pages: int = 700, seed: int = 11) -> Trees:
    """The trees, trained once in a process."""
    if not _MODEL:
        r = random.Random(seed)
        xs, ys, ws = [], [], []
        for _ in range(pages):
            nodes = parse(synthetic_page(r), marked=True)
            f = features(nodes)
            for v, row in zip(nodes, f):
                if v.y is not None:
                    xs.append(row)
                    ys.append(v.y)
                    ws.append(1.0 + math.log1p(v.own) / 3)
        _MODEL.append(Trees().fit(np.array(xs), np.array(ys, float), np.array(ws)))
    return _MODEL[0]


def extract(pages: list[str | None], model: Trees) -> list[str]:
    parsed = [parse(p) if p else None for p in pages]
    rows = [features(v) for v in parsed if v]
    if not rows:
        return ["" for _ in pages]
    odds = model.predict(np.concatenate(rows))
    out, at = [], 0
    for v in parsed:
        if not v:
            out.append("")
            continue
        own = odds[at : at + len(v)]
        at += len(v)
        out.append(text_of(v, decode(v, own)))
    return out


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of pages (page_id, url, html)."""
    sent = pages.sparkSession.sparkContext.broadcast(train())

    def run(batches):
        for b in (b for batch in batches for b in slices(batch, 2, 1_000_000)):
            text = extract(b.column(2).to_pylist(), sent.value)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(tidied(run), "page_id long, url string, text string, n_chars long")


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
