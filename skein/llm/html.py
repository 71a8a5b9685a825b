"""Main text of web pages: boosted trees over DOM nodes, decoded down the tree."""

from __future__ import annotations

import html as _html
import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import map_batches, table

#: Trees, their depth, learning rate, and bins of a feature.
TREES, DEPTH, RATE, BINS = 60, 4, 0.25, 48
#: Synthetic pages on which the trees are grown, and their seed.
TRAIN_PAGES, SEED = 500, 11

# Element names of HTML and the words that class, id and role attributes use.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg textarea select object".split())
HIDDEN = frozenset("head title".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "tbody", "thead"}, "tfoot": {"tr", "td", "th", "tbody", "thead"}}
LISTS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}, "tfoot": {"table"}}
CODES = {t: k for k, ts in enumerate(("html body", "div", "section", "article", "main", "nav", "aside", "header", "footer", "form fieldset", "button", "ul ol dl menu", "li dt dd", "p", "h1", "h2 h3 h4 h5 h6", "blockquote pre figure figcaption", "table thead tbody tfoot tr", "td th caption", "dialog details summary")) for t in ts.split()}
GOOD = frozenset("article articlebody content entry main post story text body prose page".split())
BAD = frozenset("ad ads advert advertisement banner breadcrumb breadcrumbs byline comment comments consent cookie cookies disqus footer form gdpr header hidden login masthead menu meta modal nav navbar navigation newsletter notice pager pagination popup promo promoted recommended related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe tags teaser toolbar tracking widget".split())

#: In a tag, a quote opens a value only right after ``=``, and only if it is closed somewhere; elsewhere it is an ordinary character.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]*))*+)>?", re.S)
_ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(?:class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[a-z]+")
#: Elements that stop the search for an open paragraph.
_BOUNDS = frozenset("table td div article section body li blockquote".split())


@dataclass
class Tree:
    """A page's block elements in document order, and its pieces of text as (element, text, characters in links)."""

    tag: list[int]
    parent: list[int]
    depth: list[int]
    good: list[int]
    bad: list[int]
    text: list[tuple[int, str, int]]


def parse(page: str) -> Tree:
    """Elements with implied end tags; scripts, styles, comments and the head leave no text.

    Character references are decoded and white space inside a block becomes one
    space.  Inline elements and ``br`` belong to the block around them.  Broken
    markup is read as far as it goes: unclosed elements end with the page,
    stray end tags are ignored, a lone ``<`` is text, and a quote in a tag that
    no other closes hides nothing.  The work is linear in the page, however
    deep its elements are nested.
    """
    tree = Tree([0], [-1], [0], [0], [0], [])
    stack: list[tuple[str, int]] = [("html", 0)]
    opened: dict[str, list[int]] = {}  # places of the open elements in the stack, by name
    piece: list[str] = []
    linked, links, hidden = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if piece:
            line = " ".join(_html.unescape("".join(piece)).split())
            if line:
                tree.text.append((stack[-1][1], line, min(linked, len(line))))
            piece.clear()
        linked = 0

    def close(upto: int) -> None:
        nonlocal hidden
        flush()
        for name, _ in stack[upto:]:
            hidden -= name in HIDDEN
            opened[name].pop()
        del stack[upto:]

    def last(names) -> int:
        """Place of the innermost open element of these names, 0 without one."""
        return max((opened[x][-1] for x in names if opened.get(x)), default=0)

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        start = m.start() if m else end
        if start > at and not hidden:
            piece.append(page[at:start])
            if links:
                linked += start - at
        if not m:
            break
        at = m.end()
        name = m[2]
        if name is None:
            if m[0].startswith("<![CDATA[") and not hidden:
                piece.append(_html.escape(m[0][9:].removesuffix("]]>")))
            continue
        name = name.lower()
        if name in INLINE:
            if name == "br":
                piece.append(" ")
            elif name == "a":
                links = 0 if m[1] else 1
            continue
        if m[1]:
            k = last((name,))
            if k:
                close(k)
                links = 0
            elif name in CLOSES_P:
                flush()
            continue
        if name in RAW:
            if not m[0].endswith("/>"):
                stop = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = stop.end() if stop else end
            piece.append(" ")
            continue
        if name in VOID:
            if name == "hr":
                flush()
            continue
        if name in ("html", "body"):
            flush()
            if hidden and name == "body":
                close(1)
            continue
        if name in CLOSES_P:
            k = last(("p",))
            if k > last(_BOUNDS):
                close(k)
        if name in SAME:
            k = last(SAME[name])
            if k > last(LISTS.get(name, ())):
                close(k)
        flush()
        good = bad = 0
        for a in _ATTRIBUTE.finditer(m[3]):
            words = _WORDS.findall((a[1] or a[2] or a[3] or "").lower())
            good += sum(w in GOOD for w in words)
            bad += sum(w in BAD for w in words)
        tree.tag.append(CODES.get(name, len(CODES) + 1 if name not in HIDDEN else 99))
        tree.parent.append(stack[-1][1])
        tree.depth.append(len(stack))
        tree.good.append(good)
        tree.bad.append(bad)
        if not m[0].endswith("/>"):
            opened.setdefault(name, []).append(len(stack))
            stack.append((name, len(tree.tag) - 1))
            hidden += name in HIDDEN
    close(1)
    flush()
    return tree


def levels_of(depth: np.ndarray) -> list[np.ndarray]:
    """The nodes of every depth, by one sort."""
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.searchsorted(depth[order], np.arange(1, int(depth.max()) + 1)))


def features(trees: list[Tree]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features, parent, depth, own characters, piece's node, piece's page) over the nodes of all pages, numbered through."""
    base = np.cumsum([0, *(len(t.tag) for t in trees)])
    n = int(base[-1])
    cat = lambda name: np.array([x for t in trees for x in getattr(t, name)])
    tag, depth, good, bad = cat("tag"), cat("depth"), cat("good"), cat("bad")
    parent = np.array([x + b if x >= 0 else -1 for t, b in zip(trees, base, strict=False) for x in t.parent])
    page = np.repeat(np.arange(len(trees)), np.diff(base))
    of = np.array([k + b for t, b in zip(trees, base, strict=False) for k, _, _ in t.text], dtype=np.int64)
    of_page = page[of] if len(of) else np.zeros(0, np.int64)
    size = np.array([len(x) for t in trees for _, x, _ in t.text], dtype=np.float64)
    link = np.array([x for t in trees for _, _, x in t.text], dtype=np.float64)
    stops = np.array([sum(map(x.count, ".,;:!?")) for t in trees for _, x, _ in t.text], dtype=np.float64)
    own, own_link, own_stop = (np.bincount(of, v, n) if len(of) else np.zeros(n) for v in (size, link, stops))
    levels = levels_of(depth)
    sub, sub_link, sub_stop, sub_nodes = own.copy(), own_link.copy(), own_stop.copy(), np.ones(n)
    for at in reversed(levels[1:]):
        for v in (sub, sub_link, sub_stop, sub_nodes):
            np.add.at(v, parent[at], v[at])
    up = np.maximum(parent, 0)
    bad_above, good_above = np.zeros(n), np.zeros(n)
    inside = {k: np.zeros(n) for k in ("nav aside header footer", "article main", "form")}
    codes = {k: np.isin(tag, [CODES[x] for x in k.split()]) for k in inside}
    for at in levels[1:]:
        bad_above[at] = bad_above[up[at]] + bad[up[at]]
        good_above[at] = good_above[up[at]] + good[up[at]]
        for k, v in inside.items():
            v[at] = v[up[at]] + codes[k][up[at]]
    kids = np.bincount(up[1:] if n > 1 else up[:0], minlength=n) if n else np.zeros(0)
    kids = np.bincount(parent[parent >= 0], minlength=n)
    kid_own = np.bincount(parent[parent >= 0], own[parent >= 0], n)
    kid_link = np.bincount(parent[parent >= 0], sub_link[parent >= 0], n)
    same = up * 128 + tag
    _, back, many = np.unique(same, return_inverse=True, return_counts=True)
    first = np.zeros(n)
    if len(of):
        before = np.cumsum(size) - size
        began = np.full(n, np.inf)
        np.minimum.at(began, of, before)
        for at in reversed(levels[1:]):
            np.minimum.at(began, parent[at], began[at])
        total = np.bincount(of_page, size, len(trees))
        lead = np.cumsum(total) - total
        first = np.where(np.isfinite(began), (began - lead[page]) / np.maximum(total[page], 1), 0)
        share = sub / np.maximum(total[page], 1)
    else:
        share = np.zeros(n)
    x = np.stack([
        depth, tag, np.log1p(own), np.log1p(sub), own_link / np.maximum(own, 1), sub_link / np.maximum(sub, 1), np.log1p(sub_nodes), np.log1p(sub / sub_nodes),
        good, bad, good_above, bad_above, inside["nav aside header footer"], inside["article main"], inside["form"], tag[up],
        kids[up], many[back], kid_own[up] / np.maximum(kids[up], 1), kid_link[up] / np.maximum(sub[up], 1), own_stop / np.maximum(own, 1), sub_stop / np.maximum(sub, 1), first, share, kids,
    ], axis=1).astype(np.float32)
    return x, parent, depth, own, of, of_page


class Boosted:
    """Gradient-boosted regression trees on the logistic loss, complete to a fixed depth, over binned features."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS):
        self.trees, self.depth, self.rate, self.bins = trees, depth, rate, bins

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Boosted:
        n, d = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(d)]
        binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], axis=1)
        share = float(np.clip((weight * y).sum() / weight.sum(), 1e-3, 1 - 1e-3))
        self.start = float(np.log(share / (1 - share)))
        score = np.full(n, self.start)
        self.splits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = weight * (y - p), weight * p * (1 - p)
            leaf = np.zeros(n, np.int64)
            feature, cut = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, np.inf)
            for level in range(self.depth):
                first, many = 2**level - 1, 2**level
                best = np.full(many, 1e-6)
                pick_f, pick_b = np.zeros(many, np.int64), np.full(many, self.bins + 1)
                for j in range(d):
                    key = leaf * (self.bins + 1) + binned[:, j]
                    sg = np.bincount(key, g, many * (self.bins + 1)).reshape(many, -1).cumsum(axis=1)
                    sh = np.bincount(key, h, many * (self.bins + 1)).reshape(many, -1).cumsum(axis=1)
                    tg, th = sg[:, -1:], sh[:, -1:]
                    gain = sg**2 / (sh + 1) + (tg - sg) ** 2 / (th - sh + 1) - tg**2 / (th + 1)
                    gain[:, len(self.edges[j]) :] = 0
                    at = gain.argmax(axis=1)
                    top = gain[np.arange(many), at]
                    better = top > best
                    best[better], pick_f[better], pick_b[better] = top[better], j, at[better]
                feature[first : first + many] = pick_f
                for k in range(many):
                    if pick_b[k] <= self.bins:
                        cut[first + k] = self.edges[pick_f[k]][pick_b[k]]
                leaf = 2 * leaf + (binned[np.arange(n), pick_f[leaf]] > pick_b[leaf])
            value = self.rate * np.bincount(leaf, g, 2**self.depth) / (np.bincount(leaf, h, 2**self.depth) + 1)
            score += value[leaf]
            self.splits.append((feature, cut.astype(np.float32), value.astype(np.float32)))
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start, np.float32), np.arange(len(x))
        for feature, cut, value in self.splits:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += value[node - (2**self.depth - 1)]
        return out


def decode(log_odds: np.ndarray, parent: np.ndarray, depth: np.ndarray, own: np.ndarray, dead: np.ndarray) -> np.ndarray:
    """Which nodes keep their own text: the best labelling in which no node is kept below a dropped one.

    A node's choice weighs its log odds by the logarithm of its own text.  From
    the leaves up, a kept node gains the better choice of each child, a dropped
    one loses its whole subtree; from the root down the choices are read off.
    """
    gain = log_odds * np.log1p(own)
    keep, drop = gain.copy(), -gain
    keep[dead] = -1e9
    levels = levels_of(depth)
    for at in reversed(levels[1:]):
        np.add.at(keep, parent[at], np.maximum(keep[at], drop[at]))
        np.add.at(drop, parent[at], drop[at])
    chosen = np.zeros(len(parent), bool)
    chosen[levels[0]] = True  # the page itself only holds the rest
    for at in levels[1:]:
        chosen[at] = chosen[parent[at]] & (keep[at] > drop[at])
    return chosen


def extract(model: Boosted, pages: list[str]) -> list[str]:
    """The main text of each page."""
    trees = [parse(p) for p in pages]
    if not trees:
        return []
    x, parent, depth, own, of, page = features(trees)
    chosen = decode(model.log_odds(x), parent, depth, own, x[:, 1] == 99)
    out: list[list[str]] = [[] for _ in trees]
    lines = [line for t in trees for _, line, _ in t.text]
    for k in np.flatnonzero(chosen[of]).tolist() if len(of) else []:
        out[page[k]].append(lines[k])
    return ["\n".join(x) for x in out]


def synthetic_page(rng: random.Random) -> list[tuple[str, bool | None]]:
    """A page as (markup or text, is it main text) pieces; None: markup."""
    letters = "aeioulmnrstdkpbv"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(2, 9)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))

    def prose(a: int, b: int) -> str:
        return " ".join(words(3, 14).capitalize() + rng.choice(".?!...") for _ in range(rng.randint(a, b)))

    out: list[tuple[str, bool | None]] = []
    put = lambda *xs: out.extend((x, None) for x in xs)

    def wrap(tag: str, body, attr: str = "") -> None:
        if tag in ("nav", "header", "footer", "aside", "form", "article", "main") and rng.random() < 0.6:
            attr = ""  # the element's name says it
        put(f"<{tag}{attr}>")
        body()
        if not (tag in ("p", "li") and rng.random() < 0.2):
            put(f"</{tag}>")

    def text(s: str, main: bool) -> None:
        out.append((s, main))

    def links(main: bool = False, n: int | None = None) -> None:
        def items() -> None:
            for _ in range(n or rng.randint(2, 9)):
                wrap("li", lambda: (put(f'<a href="/{word()}">'), text(words(1, 4), main), put("</a>")))

        wrap(rng.choice(("ul", "ul", "ol")), items)

    def attr(*choices: str) -> str:
        c = rng.choice(choices)
        return "" if not c else f' {rng.choice(("class", "class", "id"))}="{c}{rng.choice(("", "", " " + word(), "-" + word()))}"'

    def nav() -> None:
        wrap(*((rng.choice(("nav", "div", "header")), lambda: (wrap(rng.choice(("h1", "div", "p")), lambda: text(words(1, 4), False)) if rng.random() < 0.3 else None, links()), attr("nav", "menu", "navbar", "main-navigation", "header", "site-menu"))))

    def box() -> None:
        kind = rng.choice(("ad", "promo", "cookie", "newsletter", "related", "sidebar", "share", "notice", "form"))
        body = lambda: wrap("p", lambda: text(prose(1, 2) if rng.random() < 0.7 else words(2, 8), False)) if rng.random() < 0.5 else text(words(4, 14).capitalize() + ".", False)
        if kind == "related":
            wrap(rng.choice(("div", "section", "aside")), lambda: (wrap("h3", lambda: text(words(1, 4), False)), links()), attr("related", "recommended", "related-posts"))
        elif kind == "form":
            wrap("form", lambda: (body(), wrap("button", lambda: text(words(1, 2), False))), attr("", "signup", "search-form", "subscribe"))
        elif kind == "sidebar":
            wrap(rng.choice(("aside", "aside", "div")), lambda: (wrap("h3", lambda: text(words(1, 3), False)), body(), links() if rng.random() < 0.5 else body()), attr("sidebar", "widget", "sidebar-widget"))
        else:
            wrap(rng.choice(("div", "div", "section", "aside")), body, attr(*{"ad": ("ad", "ads", "advert", "banner", "sponsored"), "promo": ("promo", "teaser", "promoted"), "cookie": ("cookie", "cookie-consent", "gdpr", "consent banner"), "newsletter": ("newsletter", "subscribe"), "share": ("share", "social", "sharing"), "notice": ("notice", "site-notice", "login notice")}[kind]))

    def comments() -> None:
        def one() -> None:
            wrap(rng.choice(("p", "div")), lambda: text(words(1, 3), False))
            for _ in range(rng.randint(1, 3)):
                wrap("p", lambda: text(prose(1, 5), False))

        wrap(rng.choice(("section", "div", "ol", "aside")), lambda: (wrap("h2", lambda: text(words(1, 3), False)), [wrap(rng.choice(("div", "li", "article")), one, attr("comment", "reply", "comment-body")) for _ in range(rng.randint(1, 6))]), attr("comments", "comment-list", "disqus", "replies", "respond"))

    def article() -> None:
        if rng.random() < 0.85:
            wrap(rng.choice(("h1", "h1", "h2")), lambda: text(words(1, 10).capitalize(), True))
        if rng.random() < 0.15:
            wrap(rng.choice(("p", "div")), lambda: text(words(2, 6), False), attr("byline", "meta", "post-meta"))
        for k in range(rng.choice((1, 1, 2, 3, 5, 8, 14))):
            r = rng.random()
            if r < 0.08:
                wrap(rng.choice(("h2", "h3")), lambda: text(words(1, 6).capitalize(), True))
            elif r < 0.13:
                wrap(rng.choice(("ul", "ol")), lambda: [wrap("li", lambda: text(words(3, 20), True)) for _ in range(rng.randint(2, 6))])
            elif r < 0.17:
                wrap("blockquote", lambda: wrap("p", lambda: text(prose(1, 3), True)))
            elif r < 0.2:
                wrap("table", lambda: [wrap("tr", lambda: [wrap("td", lambda: text(words(1, 4), True)) for _ in range(3)]) for _ in range(rng.randint(2, 4))])
            elif r < 0.23:
                wrap("pre", lambda: text(words(4, 30), True))
            elif r < 0.3 and k:
                box()
            wrap("p", lambda: (put("<b>") if rng.random() < 0.2 else None, text(prose(1, rng.choice((1, 2, 4, 9))) if rng.random() < 0.85 else words(1, 5), True), put("<br>") if rng.random() < 0.2 else None))

    put("<html><head><title>", words(2, 6), "</title><script>var a=1;</script></head><body>")
    for _ in range(rng.randint(0, 2)):
        rng.choice((nav, box))()
    if rng.random() < 0.8:
        nav()
    shell = rng.random()
    if shell < 0.5:
        inner = lambda: wrap("article", article, attr("", "", "post", "entry"))
    else:
        inner = lambda: wrap(rng.choice(("main", "div", "div", "section")), article, attr("content", "post", "entry-content", "main", "story", "article-body", "text"))
    parts = [inner] + [x for x, p in ((box, 0.5), (comments, 0.45), (box, 0.3)) if rng.random() < p]
    if rng.random() < 0.3:
        parts.insert(0, box)
    body = lambda: [p() for p in parts]
    wrap("div", body, attr("page", "wrapper", "container", "")) if rng.random() < 0.5 else body()
    if rng.random() < 0.85:
        wrap(rng.choice(("footer", "footer", "div")), lambda: (text("© " + words(2, 9), False), links() if rng.random() < 0.3 else None), attr("footer", "site-footer"))
    put("</body></html>")
    return out


def train(pages: int = TRAIN_PAGES, seed: int = SEED) -> Boosted:
    """Trees grown on synthetic pages whose main text is known; the same for the same arguments."""
    rng = random.Random(seed)
    made = [synthetic_page(rng) for _ in range(pages)]
    trees = [parse("".join(x for x, _ in p)) for p in made]
    x, parent, depth, own, of, page = features(trees)
    main = [{" ".join(s.split()) for s, m in p if m} for p in made]
    lines = [line for t in trees for _, line, _ in t.text]
    good = np.array([line in main[k] for line, k in zip(lines, page, strict=True)], float)
    size = np.array([len(line) for line in lines], float)
    up, all_ = np.bincount(of, good * size, len(parent)), np.bincount(of, size, len(parent))
    levels = levels_of(depth)
    for at in reversed(levels[1:]):
        np.add.at(up, parent[at], up[at])
        np.add.at(all_, parent[at], all_[at])
    ok = (all_ > 0) & (depth > 0) & (x[:, 1] != 99)
    share = up[ok] / all_[ok]
    # a mixed container teaches little; a node with text of its own counts in full
    weight = np.where(own[ok] > 0, 1.0, 0.3) * (0.1 + 0.9 * np.abs(2 * share - 1))
    return Boosted().fit(x[ok], (share > 0.5).astype(float), weight)


def main_text(pages: DataFrame, html_col: str = "html", out_col: str = "text", model: Boosted | None = None) -> DataFrame:
    """``pages`` without ``html_col`` and with ``out_col``, the main text (empty if there is none; null html is an empty page; a column ``out_col`` is replaced).

    Every row is worked on by itself, so nothing is shuffled and repeated rows stay repeated.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or train())
    others = [c for c in pages.columns if c != html_col and c != out_col]
    rows = pages.select(F.col(html_col).alias("_skein_html"), *[F.col(f"`{c}`") for c in others])

    def make(batch: pa.RecordBatch) -> dict:
        got = extract(shared.value, [p or "" for p in batch.column(0).to_pylist()])
        return {out_col: pa.array(got, pa.string())} | {c: batch.column(i + 1) for i, c in enumerate(others)}

    schema = ", ".join([f"`{out_col}` string", *(f"`{c}` {t}" for c, t in rows.drop("_skein_html").dtypes)])
    return map_batches(rows, make, schema, text_at=0)


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    out = main_text(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
