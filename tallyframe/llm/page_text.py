"""Main text of web pages: gradient-boosted trees over DOM nodes, and hierarchical decoding.

Every block element is described by its own and its subtree's text, density of tags and links, attribute words,
depth, and its standing among its siblings. A boosted model, trained on a bounded sample of the pages, gives
each node a probability of being article text. Decoding picks the best consistent labelling of the tree: outside
the article a node may be mixed, an article node may leave out a child, and nothing below a left-out node is
taken, so ancestor and descendant never contradict each other.

There are no hand-made labels: pages that mark their article and their boilerplate with semantic elements teach
the model. Each such page is seen twice, once as it is and once with its semantic names and attributes
removed, so that densities and position must do for pages without them.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_or_empty
from .dom import Page

#: Attribute words that speak for and against article text.
FOR = frozenset("article body content entry main post story text".split())
AGAINST = frozenset(
    "ad ads advert advertisement banner breadcrumb breadcrumbs byline comment comments consent cookie cookies disqus footer form gdpr header "
    "login masthead menu modal nav navbar navigation newsletter notice overlay pagination pager popup privacy promo promoted recommended related "
    "reply replies respondents search share sharing sidebar sidenav signup skip social sponsor sponsored subscribe tags toolbar topbar widget widgets".split())
AGAINST_TAGS = frozenset("nav footer aside form header button fieldset menu dialog".split())
ARTICLE_TAGS = frozenset("article main".split())
KINDS = [ARTICLE_TAGS, frozenset(["nav", "menu"]), frozenset(["header"]), frozenset(["footer"]), frozenset(["aside"]), frozenset("form button fieldset dialog".split()),
         frozenset(["p", "blockquote", "pre"]), frozenset("h1 h2 h3 h4 h5 h6".split()), frozenset("ul ol li dl dt dd".split()), frozenset("table tr td th tbody".split()),
         frozenset("div section span center".split()), frozenset(["body", "html", "#root"])]
FIT_PAGES = 400  # pages that the model is trained on, at most


def features(page: Page, blind: bool = False) -> np.ndarray:
    """One row per node. ``blind``: semantic names count as ``div`` and attribute words are not seen."""
    n = len(page.tag)
    parent = np.array(page.parent)
    own, linked = np.array(page.own, dtype=np.float64), np.array(page.linked, dtype=np.float64)
    text, links, tags, blocks = own.copy(), linked.copy(), np.ones(n), np.array([t == "p" for t in page.tag], dtype=np.float64)
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        text[p] += text[i]
        links[p] += links[i]
        tags[p] += tags[i]
        blocks[p] += blocks[i]
    tag = page.tag
    if blind:
        tag = ["div" if t in ARTICLE_TAGS or t in AGAINST_TAGS else t for t in tag]
    kind = np.array([next((k for k, names in enumerate(KINDS) if t in names), len(KINDS)) for t in tag])
    pro = np.array([0 if blind else len(t & FOR) for t in page.tokens], dtype=np.float64)
    con = np.array([0 if blind else len(t & AGAINST) for t in page.tokens], dtype=np.float64)
    against = (con > 0) | ((kind >= 1) & (kind <= 5))
    inside, below = (kind == 0) | (pro > 0), against.copy()
    for i in range(1, n):
        p = page.parent[i]
        inside[i] |= inside[p] and not against[i]
        below[i] |= below[p]
    before = np.cumsum(own) - own
    up = np.maximum(parent, 0)
    children = np.bincount(up[1:], minlength=n) if n > 1 else np.zeros(n)
    order = np.zeros(n)
    seen: dict[int, int] = {}
    for i in range(1, n):
        order[i] = seen.get(page.parent[i], 0)
        seen[page.parent[i]] = int(order[i]) + 1
    siblings = np.maximum(children[up], 1)
    total = max(text[0], 1.0)
    share = lambda a, b: a / np.maximum(b, 1.0)
    cols = [kind, np.array(page.depth), np.log1p(own), np.log1p(text), share(links, text), share(tags, text), share(blocks, tags), text / total,
            share(text, text[up]), before / total, order / siblings, siblings, children, pro, con, inside, below,
            share(links[up], text[up]), share(text[up], np.full(n, total)), kind[up]]
    return np.stack([np.asarray(c, dtype=np.float64) for c in cols], axis=1)


def taught(page: Page) -> list[int]:
    """Labels from the page's own semantics: 1 article, 0 boilerplate, -1 neither (or nothing to learn)."""
    n = len(page.tag)
    semantic = any(t in ARTICLE_TAGS or "articlebody" in k for t, k in zip(page.tag, page.tokens, strict=True))
    label = [-1] * n
    for i in range(1, n):
        up, tag, marks = label[page.parent[i]], page.tag[i], page.tokens[i]
        if up == 0 or marks & AGAINST or tag in AGAINST_TAGS and not (tag == "header" and up == 1):
            label[i] = 0
        elif up == 1 or tag in ARTICLE_TAGS or "articlebody" in marks:
            label[i] = 1
        elif not semantic and tag == "p" and page.own[i] > 80 and page.linked[i] < 0.3 * page.own[i]:
            label[i] = 1
    if semantic:  # what stands outside the article and holds text of its own is none of it
        label = [0 if v < 0 and own else v for v, own in zip(label, page.own, strict=True)]
    return label


class Trees:
    """A boosted model as arrays, applied to many rows at once."""

    def __init__(self, model: GBTClassifier | None):
        self.trees = [] if model is None else [(w, self._read(t.toDebugString)) for w, t in zip(model.treeWeights, model.trees, strict=True)]

    @staticmethod
    def _read(debug: str) -> tuple[np.ndarray, ...]:
        feature, cut, left, right, value = [], [], [], [], []
        lines = iter([x.strip() for x in debug.splitlines()[1:] if x.strip()])

        def node() -> int:
            line, at = next(lines), len(feature)
            for column, x in ((feature, 0), (cut, 0.0), (left, at), (right, at), (value, 0.0)):
                column.append(x)
            if line.startswith("Predict:"):
                value[at] = float(line.split(":")[1])
                cut[at] = math.inf
                return at
            m = re.match(r"If \(feature (\d+) <= (\S+)\)", line)
            feature[at], cut[at] = int(m[1]), float(m[2])
            left[at] = node()
            next(lines)  # the matching Else
            right[at] = node()
            return at

        node()
        return tuple(map(np.array, (feature, cut, left, right, value)))

    def probability(self, rows: np.ndarray) -> np.ndarray:
        margin = np.zeros(len(rows))
        at_row = np.arange(len(rows))
        for weight, (feature, cut, left, right, value) in self.trees:
            at = np.zeros(len(rows), dtype=np.int64)
            while True:
                down = np.where(rows[at_row, feature[at]] <= cut[at], left[at], right[at])
                if (down == at).all():
                    break
                at = down
            margin += weight * value[at]
        return 1.0 / (1.0 + np.exp(-2.0 * margin)) if self.trees else np.full(len(rows), 0.5)


def decode(page: Page, p: np.ndarray) -> list[bool]:
    """The best consistent labelling: which nodes' own texts are kept."""
    n = len(page.tag)
    p = np.clip(p, 1e-4, 1 - 1e-4)
    weigh = np.log1p(np.array(page.own, dtype=np.float64)) + 0.1  # a decision counts by the text it moves
    yes, no = (weigh * np.log(p)).tolist(), (weigh * np.log1p(-p)).tolist()
    content, left_out, mixed = yes[:], no[:], [0.0 if not o else v for o, v in zip(page.own, no, strict=True)]
    for i in range(n - 1, 0, -1):
        up = page.parent[i]
        content[up] += max(content[i], left_out[i])
        left_out[up] += left_out[i]
        mixed[up] += max(content[i], left_out[i], mixed[i])
    state = [2] * n  # 0 left out, 1 content, 2 mixed; the root is mixed, its own text left out
    for i in range(1, n):
        up = state[page.parent[i]]
        if up == 0:
            state[i] = 0
        elif up == 1:
            state[i] = int(content[i] >= left_out[i])
        else:
            state[i] = max(((content[i], 1), (mixed[i], 2), (left_out[i], 0)))[1]
    return [s == 1 for s in state]


def fit(pages: DataFrame, iterations: int = 20, depth: int = 4, seed: int = 3) -> Trees:
    """Train on the rows of ``pages`` (``html``), which the caller has bounded; without both labels, no trees."""

    def run(batches):
        for batch in batches:
            xs, ys = [], []
            for h in batch.column("html"):
                page = Page(h.as_py())
                y = np.array(taught(page))
                for blind in (False, True):
                    xs.append(features(page, blind)[y >= 0])
                    ys.append(y[y >= 0])
            x, y = np.concatenate(xs), np.concatenate(ys)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), pa.array(y.astype(np.float64))], names=["x", "y"])

    rows = materialise(pages.select("html").mapInArrow(run, "x array<double>, y double"))
    low, high = rows.agg(F.min("y"), F.max("y")).first()
    if low is None or low == high:
        return Trees(None)
    vectors = rows.select(array_to_vector("x").alias("features"), F.col("y").alias("label"))
    return Trees(GBTClassifier(maxIter=iterations, maxDepth=depth, maxBins=64, minInstancesPerNode=10, seed=seed).fit(vectors))


def extract(pages: DataFrame, trees: Trees) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row. A null or empty page has an empty text."""

    def run(batches):
        for batch in batches:
            texts: list[str] = []
            held: list[Page] = []
            size = 0

            def flush(held, texts):
                if held:
                    rows = [features(p) for p in held]
                    p = trees.probability(np.concatenate(rows))
                    ends = np.cumsum([len(r) for r in rows])
                    texts += [page.text(decode(page, p[e - len(r):e])) for page, r, e in zip(held, rows, ends, strict=True)]

            for h in batch.column("html"):
                held.append(Page(h.as_py()))
                size += len(held[-1].tag)
                if size > 20_000:
                    flush(held, texts)
                    held, size = [], 0
            flush(held, texts)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_or_empty("html").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def main_text(pages: DataFrame, fit_pages: int = FIT_PAGES) -> DataFrame:
    """Train on at most ``fit_pages`` pages, the first by a hash of their html's share of the table, and extract all."""
    n = pages.count()
    sample = pages.select(text_or_empty("html").alias("html")).filter(F.pmod(F.xxhash64("html"), F.lit(max(1, n // fit_pages))) == 0).limit(fit_pages)
    return extract(pages, fit(sample))
