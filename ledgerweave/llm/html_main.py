"""Main text of web pages by gradient-boosted trees over DOM nodes, decoded top down.

A page is parsed into elements. Each element has features: densities of text, links and tags in its subtree, depth,
position and statistics of its siblings, and tokens of its tag, class, id and role. Boosted trees estimate whether an
element holds main text, itself or below. Decoding finds the most likely labelling in which a part of main text lies only
inside elements that hold main text: a dropped element drops everything below it, a kept one has kept ancestors. The text
of kept elements is the result.

No page is labelled, so the trees learn from weak labels on a bounded sample. ``TRAINING_PAGES`` pages with the smallest
hash of their id are taken; their semantic elements (article or main against nav, aside, footer, header, form and elements
whose attributes name an advert) say what is main text. Each sampled page is also shown in rewritten variants: semantic
elements become plain ones with class names, order and nesting change, and menus, sidebars, notices, forms and comments are
added from the words of other parts of the page. So the trees also learn pages that name nothing clearly.

Defined results: a NULL or empty page, or one without kept text, has an empty text; unclosed, misnested and cut-off markup
is read as far as it goes; rows with a repeated or NULL page_id are extracted row by row; without any training page
(empty table) the result is empty.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.llm.common import batches, written

TRAINING_PAGES = 300
VARIANTS = 6  # rewritten forms of each training page
TREES, TREE_DEPTH = 30, 5
TOKEN_BUCKETS = 48
SEED = 3

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head script style noscript template title textarea select option svg math iframe object canvas button".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
# An opening tag on the left ends these open elements, up to the nearest of the containers.
ENDS = {
    **{t: (("p",), ("td", "th", "li", "div", "article", "section", "body")) for t in BLOCKS - {"li", "td", "th", "tr", "dd", "dt", "html", "body"}},
    "li": (("li", "p"), ("ul", "ol", "menu")),
    "dd": (("dd", "dt", "p"), ("dl",)),
    "dt": (("dd", "dt", "p"), ("dl",)),
    "td": (("td", "th", "p"), ("tr", "table")),
    "th": (("td", "th", "p"), ("tr", "table")),
    "tr": (("tr", "td", "th", "p"), ("table", "tbody", "thead", "tfoot")),
}
TAGS = "article main section div p h1 h2 h3 h4 ul ol li a nav aside header footer form table tr td blockquote pre span b body figure dl".split()


class Node:
    """An element with its children: nodes and strings in page order."""

    __slots__ = ("tag", "attrs", "parent", "children")

    def __init__(self, tag: str, attrs: list, parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []


class Dom(HTMLParser):
    """Builds a tree from any markup."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.here = Node("#root", [], None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        ends, within = ENDS.get(tag, ((), ()))
        node = self.here
        while node.parent is not None and node.tag not in within and ends:
            if node.tag in ends:
                self.here = node.parent
            node = node.parent
        child = Node(tag, attrs, self.here)
        self.here.children.append(child)
        if tag not in VOID:
            self.here = child

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        node = self.here
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.here = node.parent

    def handle_data(self, data: str) -> None:
        self.here.children.append(data)


def parsed(html: str | None) -> Node:
    dom = Dom()
    try:
        dom.feed(html or "")
        dom.close()
    except (AssertionError, ValueError):
        pass  # the parser gives up on a few broken declarations; what it has read stands
    return dom.root


def elements(root: Node) -> list[Node]:
    """All elements that a reader can see, ancestors first, in page order."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [c for c in reversed(node.children) if isinstance(c, Node) and c.tag not in UNSEEN and c.tag not in VOID]
    return out


_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[a-z]+")


def names(node: Node) -> list[str]:
    """Words of the attributes that say what an element is."""
    return [w for k, v in node.attrs if k in ("class", "id", "role", "itemprop", "aria-label") and v for w in _NAME.findall(v.lower())]


def features(nodes: list[Node]) -> np.ndarray:
    """One row of features for each of a page's elements."""
    at = {id(n): i for i, n in enumerate(nodes)}
    n = len(nodes)
    own, links, tags, paragraphs, stops, depth = (np.zeros(n) for _ in range(6))
    for i, node in enumerate(nodes):
        text = "".join(c for c in node.children if isinstance(c, str))
        own[i] = len(_SPACE.sub(" ", text).strip())
        stops[i] = sum(map(text.count, ".!?"))
        depth[i] = depth[at[id(node.parent)]] + 1 if i else 0
    text, tags[:] = own.copy(), 1
    links[:] = [own[i] if x.tag == "a" else 0 for i, x in enumerate(nodes)]
    paragraphs[:] = [x.tag == "p" for x in nodes]
    for i in range(n - 1, 0, -1):
        up = at[id(nodes[i].parent)]
        for total in (text, tags, paragraphs, stops, links):
            total[up] += total[i]
        if nodes[i].tag == "a":
            links[up] += text[i] - links[i]
    up = np.array([at[id(x.parent)] if i else 0 for i, x in enumerate(nodes)])
    whole = max(text[0], 1.0)
    siblings = np.bincount(up[1:], minlength=n)
    order, same = np.zeros(n), np.zeros(n)
    seen = np.zeros(n)
    pairs: dict[tuple, int] = {}
    for i in range(1, n):
        order[i] = seen[up[i]]
        seen[up[i]] += 1
        pairs[up[i], nodes[i].tag] = pairs.get((up[i], nodes[i].tag), 0) + 1
    same[1:] = [pairs[up[i], nodes[i].tag] for i in range(1, n)]
    safe = np.maximum(text, 1.0)
    base = np.column_stack([
        np.log1p(text), text / whole, links / safe, tags / safe, text / tags, paragraphs, stops / safe, own / safe, depth,
        siblings[up], order / np.maximum(siblings[up], 1), same, siblings, text / np.maximum(text[up], 1.0), (links / safe)[up], np.log1p(text[up]),
        [x.attrs != [] for x in nodes],
    ])
    kind = np.zeros((n, 2 * len(TAGS)))
    token = np.zeros((n, 2 * TOKEN_BUCKETS))
    for i, node in enumerate(nodes):
        if node.tag in TAGS:
            kind[i, TAGS.index(node.tag)] = 1
        for word in names(node):
            token[i, xxhash.xxh3_64_intdigest(word) % TOKEN_BUCKETS] = 1
        if i:  # what any ancestor is, and is called
            kind[i, len(TAGS) :] = np.maximum(kind[up[i], len(TAGS) :], kind[up[i], : len(TAGS)])
            token[i, TOKEN_BUCKETS:] = np.maximum(token[up[i], TOKEN_BUCKETS:], token[up[i], :TOKEN_BUCKETS])
    return np.hstack([base, kind, token])


def decode(nodes: list[Node], chance: np.ndarray) -> np.ndarray:
    """The most likely labels under which no element is kept inside a dropped one."""
    at = {id(n): i for i, n in enumerate(nodes)}
    yes, no = np.log(np.clip(chance, 1e-6, 1)), np.log(np.clip(1 - chance, 1e-6, 1))
    drop, keep = no.copy(), yes.copy()
    for i in range(len(nodes) - 1, 0, -1):
        up = at[id(nodes[i].parent)]
        drop[up] += drop[i]
        keep[up] += max(keep[i], drop[i])
    kept = np.zeros(len(nodes), bool)
    kept[0] = True
    for i in range(1, len(nodes)):
        kept[i] = kept[at[id(nodes[i].parent)]] and keep[i] > drop[i]
    return kept


def text_of(nodes: list[Node], kept: np.ndarray) -> str:
    """Blocks of the kept elements in page order, one a line."""
    live = {id(n) for n, k in zip(nodes, kept, strict=True) if k}
    blocks: list[str] = []
    line: list[str] = []

    def end() -> None:
        words = _SPACE.sub(" ", "".join(line)).strip()
        if words:
            blocks.append(words)
        line.clear()

    todo: list = [nodes[0]]
    while todo:
        item = todo.pop()
        if item is None:
            end()
        elif isinstance(item, str):
            line.append(item)
        elif item.tag == "br":
            line.append(" ")
        elif id(item) in live:
            if item.tag in BLOCKS:
                end()
                todo.append(None)
            todo += reversed(item.children)
        elif item.tag in BLOCKS:
            end()
    end()
    return "\n".join(blocks)


# ---- weak labels and rewritten training pages ----

_MAIN = frozenset(("article", "main"))
_OTHER = frozenset(("nav", "aside", "footer", "header", "form"))
_OTHER_NAMES = frozenset("ad ads advert banner sponsored".split())


def weak_labels(nodes: list[Node]) -> np.ndarray | None:
    """Which elements hold main text by the page's own semantic elements; None if it has none."""
    at = {id(n): i for i, n in enumerate(nodes)}
    inside = np.zeros(len(nodes), bool)
    for i, node in enumerate(nodes):
        up = inside[at[id(node.parent)]] if i else False
        inside[i] = (up or node.tag in _MAIN or ("data-main", "1") in node.attrs) and node.tag not in _OTHER and not _OTHER_NAMES & set(names(node)) and ("data-main", "0") not in node.attrs
    label = inside & np.array([any(isinstance(c, str) and c.strip() for c in x.children) for x in nodes])
    if not label.any():
        return None
    for i in range(len(nodes) - 1, 0, -1):
        if label[i]:
            label[at[id(nodes[i].parent)]] = True
    return label


_MAIN_NAMES = "content post article story entry text body main page single detail".split()
_MENU_NAMES = "menu nav navbar navigation links breadcrumb breadcrumbs topbar tabs".split()
_FOOT_NAMES = "footer foot bottom copyright legal colophon".split()
_HEAD_NAMES = "header head masthead top branding logo".split()
_SIDE_NAMES = "sidebar side widget related aside recommended popular trending".split()
_AD_NAMES = "ad ads advert banner sponsored promo sponsor".split()
_NOTICE_NAMES = "cookie notice alert consent gdpr popup modal overlay newsletter subscribe".split()
_COMMENT_NAMES = "comments comment replies reply respond discussion disqus thread".split()
_SHARE_NAMES = "share social tags meta byline pagination pager".split()


def rewritten(paragraphs: list[str], title: str, words: list[str], rng: random.Random) -> str:
    """A page in another form around the same main text; ``data-main`` marks what is main text and what is not."""
    some = lambda low, high: escape(" ".join(rng.choices(words, k=rng.randint(low, high))))

    def attrs(kinds: list[str]) -> str:
        name = rng.choice(kinds)
        if rng.random() < 0.4:
            name += rng.choice(["-", "_", " "]) + rng.choice(["box", "wrap", "area", "inner", "block", rng.choice(kinds)])
        return f'{rng.choice(["class", "class", "id"])}="{name}"' if rng.random() < 0.8 else ""

    def box(tag: str, kinds: list[str], inside: str) -> str:
        own = tag if rng.random() < 0.5 else rng.choice(["div", "section", "div"])
        return f'<{own} data-main="0" {attrs(kinds) if own != tag or rng.random() < 0.5 else ""}>{inside}</{own}>'

    items = lambda low, high, n: "<ul>" + "".join(f'<li><a href="/x">{some(1, n)}</a></li>' for _ in range(rng.randint(low, high))) + "</ul>"
    para = lambda low, high: f"<p>{some(low, high)}</p>"
    comment = lambda: f'<div {attrs(_COMMENT_NAMES)}><b>{some(1, 2)}</b>{para(4, 40)}</div>'
    makers = {
        "menu": lambda: box("nav", _MENU_NAMES, items(3, 9, 3)),
        "head": lambda: box("header", _HEAD_NAMES, rng.choice([f'<a href="/">{some(1, 3)}</a>', para(2, 8), f"<h2>{some(1, 4)}</h2>", items(2, 6, 2)])),
        "side": lambda: box("aside", _SIDE_NAMES, f"<h3>{some(1, 3)}</h3>" + rng.choice([items(3, 8, 8), para(5, 40) + para(5, 30)])),
        "ad": lambda: f'<div data-main="0" {attrs(_AD_NAMES)}>{rng.choice([some(3, 20), para(3, 25)])}</div>',
        "notice": lambda: f'<div data-main="0" {attrs(_NOTICE_NAMES)}>{para(5, 30)}<a href="#">{some(1, 2)}</a></div>',
        "form": lambda: f'<form data-main="0"><label>{some(1, 4)}</label><input><label>{some(1, 3)}</label><input></form>',
        "share": lambda: f'<div data-main="0" {attrs(_SHARE_NAMES)}>{some(1, 3)} <a href="#">{some(1, 2)}</a> <a href="#">{some(1, 2)}</a></div>',
        "comments": lambda: f'<{(tag := rng.choice(["div", "section"]))} data-main="0" {attrs(_COMMENT_NAMES)}><h3>{some(1, 3)}</h3>' + "".join(comment() for _ in range(rng.randint(1, 5))) + f"</{tag}>",
        "foot": lambda: box("footer", _FOOT_NAMES, rng.choice([f"&copy; {some(2, 14)}", para(3, 16), items(2, 6, 2)])),
    }
    make = lambda kinds, chance: "".join(makers[k]() for k in kinds if rng.random() < chance)
    inner = []
    for p in paragraphs:
        inner.append(rng.choice([f"<p>{escape(p)}</p>"] * 8 + [f"<p><b>{escape(p)}<br>", f"<blockquote><p>{escape(p)}</p></blockquote>", f"<div>{escape(p)}</div>", f"<h2>{escape(p[:50])}</h2><p>{escape(p)}</p>"]))
        if rng.random() < 0.04:
            inner.append(make([rng.choice(["ad", "share", "notice", "side"])], 1.0))
    head = f"<h1>{escape(title)}</h1>" if rng.random() < 0.8 else ""
    tag = rng.choice(["article", "main", "div", "div", "div", "section"])
    main = f'<{tag} data-main="1" {attrs(_MAIN_NAMES) if tag in ("div", "section") or rng.random() < 0.3 else ""}>{head}{"".join(inner)}{make(["share", "comments"], 0.15)}</{tag}>'
    if rng.random() < 0.4:
        main = f'<div {attrs(["wrapper", "container", "layout", "row", "column"])}>{make(["side"], 0.4)}{main}{make(["side"], 0.4)}</div>'
    before = make(rng.sample(["notice", "head", "menu", "ad", "form"], 5), 0.5)
    after = make(rng.sample(["ad", "side", "comments", "form", "notice", "share"], 6), 0.35) + make(["foot"], 0.8)
    return f"<html><body>{before}{main}{after}</body></html>"


def _training_rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("features", pa.list_(pa.float64())), ("label", pa.float64())])

    def examples(html: str) -> Iterator[tuple]:
        nodes = elements(parsed(html))
        label = weak_labels(nodes)
        if label is None:
            return
        for node in nodes:
            node.attrs = [x for x in node.attrs if x[0] != "data-main"]
        for row, y in zip(features(nodes)[1:], label[1:], strict=True):
            if row[0]:  # an element without text is the same either way
                yield row.tolist(), float(y)

    def rows():
        for part in parts:
            for key, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                nodes = elements(parsed(html))
                label = weak_labels(nodes)
                if label is None:
                    continue
                yield from examples(html)
                rng = random.Random(f"{SEED}/{key}")
                paragraphs = [x for x in text_of(nodes, label).split("\n") if x][:60]
                words = " ".join(paragraphs).split()[:2000]
                for _ in range(VARIANTS):
                    if paragraphs:
                        first = rng.randrange(len(paragraphs))
                        yield from examples(rewritten(paragraphs[first : first + rng.randint(1, 20)], paragraphs[0][:60], words, rng))

    yield from batches(schema, rows())


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> list[tuple] | None:
    """Boosted trees from weak labels of a bounded sample, each as arrays (weight, feature, threshold, left, right, value)."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    order = F.xxhash64(F.col(id_col).cast("string"), F.lit(SEED))
    sample = pages.filter(F.col(html_col).isNotNull()).select(order.alias("key"), F.col(html_col).cast("string").alias("html")).orderBy("key", F.xxhash64("html")).limit(TRAINING_PAGES)
    rows = written(sample.repartition(8, "key").mapInArrow(_training_rows, "features array<double>, label double"), "nodes")
    if rows.select("label").distinct().count() < 2:
        return None
    model = GBTClassifier(maxIter=TREES, maxDepth=TREE_DEPTH, stepSize=0.3, seed=SEED, cacheNodeIds=False, maxMemoryInMB=64).fit(
        rows.select(array_to_vector("features").alias("features"), "label")
    )
    return [(w, *_arrays(t)) for t, w in zip(model.trees, model.treeWeights, strict=True)]


def _arrays(tree) -> tuple[np.ndarray, ...]:
    """A fitted tree's nodes as arrays; a leaf is its own child."""
    feature, threshold, left, right, value = [], [], [], [], []

    def add(node) -> int:
        i = len(feature)
        for column, x in zip((feature, threshold, left, right, value), (0, 0.0, i, i, node.prediction()), strict=True):
            column.append(x)
        if node.subtreeDepth() > 0:
            feature[i], threshold[i] = node.split().featureIndex(), node.split().threshold()
            left[i], right[i] = add(node.leftChild()), add(node.rightChild())
        return i

    add(tree._java_obj.rootNode())
    return np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value)


def chances(trees: list[tuple], x: np.ndarray) -> np.ndarray:
    """Probability of the positive class for each row of ``x``."""
    total = np.zeros(len(x))
    rows = np.arange(len(x))
    for weight, feature, threshold, left, right, value in trees:
        at = np.zeros(len(x), np.int64)
        for _ in range(TREE_DEPTH):
            at = np.where(x[rows, feature[at]] <= threshold[at], left[at], right[at])
        total += weight * value[at]
    return 1 / (1 + np.exp(-2 * total))


def extract(pages: DataFrame, trees: list[tuple] | None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every row."""
    shared = pages.sparkSession.sparkContext.broadcast(trees)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value

        def rows():
            for part in parts:
                keys, urls, htmls = (c.to_pylist() for c in part.columns)
                for at in range(0, len(keys), 256):
                    pages_ = [elements(parsed(h)) for h in htmls[at : at + 256]]
                    tables = [features(p) for p in pages_]
                    chance = np.split(chances(model, np.vstack(tables)), np.cumsum([len(t) for t in tables])[:-1]) if model else [np.zeros(len(t)) for t in tables]
                    for key, url, nodes, p in zip(keys[at : at + 256], urls[at : at + 256], pages_, chance, strict=True):
                        text = text_of(nodes, decode(nodes, p))
                        yield key, url, text, len(text)

        yield from batches(schema, rows(), 1024)

    return pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
