"""HTML extraction: blocks of a page are labelled content or boilerplate by a minimum cut.

Each block has two costs from a linear classifier: one for calling it content, one for calling it
boilerplate. What a block's place in the markup says has given weights; what its text says has weights fitted on the blocks that markup labels, and decides where
markup says nothing. The costs are capacities to the terminals. Blocks that follow each other, and blocks close in the tree, are joined by
edges that cost something where the labels differ. The minimum cut gives the cheapest labelling.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template svg math iframe object canvas audio video head title select option datalist button textarea map".split())
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption legend".split())
CLOSES_P = BLOCK - {"html", "body", "dialog"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTENT_ELEMENTS = frozenset("article main".split())
BOILERPLATE_ELEMENTS = frozenset("nav header footer aside form menu dialog search".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
# Words in class and id names (split at other characters and at capitals).
CONTENT_NAMES = frozenset("article content body story post entry text main maincontent hentry prose".split())
BOILERPLATE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promotions banner nav navbar navigation menu menus breadcrumb breadcrumbs footer foot header masthead sidebar sidebars aside side rail widget widgets "
    "comment comments commentlist disqus respond reply replies discussion cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login register form search share sharing social "
    "related recommended recommendations recommend more teaser teasers outbrain taboola pagination pager tags tagcloud toolbar skip legal copyright disclaimer paywall hidden".split()
)

#: Weights of what the markup says about a block's place; over 0 speaks for content. Marks also label the blocks that the other weights are fitted on.
PLACE = {"content_element": 3.0, "boilerplate_element": -9.0, "boilerplate_name": -9.0, "content_name": 1.2, "hidden": -12.0}
#: What the text of a block says: features whose weights are fitted. These weights serve where a table has too few labelled blocks.
TEXT = {"start": -0.2, "paragraph": 0.8, "heading": 0.2, "list_item": -0.3, "link_share": -3.5, "words": 0.35, "sentence": 0.6, "copyright": -2.5}
WEIGHTS = PLACE | TEXT
#: Pages that weights are fitted on at most, those with the lowest hashes of their ids; blocks of each label that are needed; strength of the penalty on large weights.
SAMPLE_PAGES, LEAST_BLOCKS, RIDGE = 500, 50, 0.01
#: Capacities between blocks: that follow each other, and with the same parent (or grandparent).
NEXT, SAME_PARENT, SAME_GRANDPARENT = 0.5, 1.0, 0.5
SPACES = re.compile(r"[\s\x1c-\x1f\x85]+")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SENTENCE_END = re.compile(r"[.!?…:;。]['\"”’)]*$")
COPYRIGHT = re.compile(r"^\s*(©|\(c\)\s|copyright\b)|all rights reserved", re.I)
SCALE = 1000


@dataclass
class Node:
    tag: str
    parent: Node | None
    marks: frozenset[str]
    inherited: frozenset[str]


@dataclass
class Block:
    text: str
    node: Node
    link_chars: int
    tags: frozenset[str]


class Blocks(HTMLParser):
    """The blocks of a page in their order; tolerant of missing and stray end tags."""

    CDATA_CONTENT_ELEMENTS = ("script", "style")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        root = Node("", None, frozenset(), frozenset())
        self.open, self.blocks = [root], []
        self.parts: list[str] = []
        self.links = self.hidden = self.in_link = 0
        self.seen: set[str] = set()

    @property
    def node(self) -> Node:
        return self.open[-1]

    def end_block(self) -> None:
        if not self.parts:
            return
        text = SPACES.sub(" ", "".join(self.parts)).strip(" ")
        if text:
            at = next((x for x in reversed(self.open) if x.tag in BLOCK), self.open[0])
            self.blocks.append(Block(text, at, self.links, frozenset(self.seen)))
        self.parts, self.links, self.seen = [], 0, set()

    def leave_head(self, inner: tuple[str, ...] = ("noscript", "template")) -> None:
        """Closes an open head, whose end tag may be left out; not from inside elements that hold other markup there."""
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in inner:
                return
            if self.open[i].tag == "head":
                self.cut(i)
                return

    def handle_starttag(self, tag: str, attrs) -> None:
        if self.hidden and tag not in IN_HEAD:
            self.leave_head(() if tag == "body" else ("noscript", "template"))
        if tag in BLOCK:
            self.end_block()
            if tag in CLOSES_P:
                self.close("p")
            if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                self.close(tag, {"ul", "ol", "menu", "table", "dl", "select", "tbody"})
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        found = dict(attrs)
        marks = set()
        if tag in CONTENT_ELEMENTS or (found.get("role") or "") in ("main", "article"):
            marks.add("content_element")
        if tag in BOILERPLATE_ELEMENTS or (found.get("role") or "").lower() in BOILERPLATE_ROLES:
            marks.add("boilerplate_element")
        if "hidden" in found or (found.get("aria-hidden") or "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style") or "", re.I):
            marks.add("hidden")
        names = {x.lower() for a in ("class", "id") for x in NAME.findall(found.get(a) or "")}
        good, bad = names & CONTENT_NAMES, names & BOILERPLATE_NAMES
        # a name with both is a page's frame as a rule, as main-with-sidebar
        if tag not in ("html", "body", *CONTENT_ELEMENTS) and bad and not (good and tag in ("div", "section")) or tag in CONTENT_ELEMENTS and names & {"comment", "comments", "ad", "ads", "advert", "promo", "sponsored", "related"}:
            marks.add("boilerplate_name")
        if good:
            marks.add("content_name")
        up = self.node
        # an article's own header holds its heading
        if tag == "header" and "content_element" in up.inherited:
            marks.discard("boilerplate_element")
        self.open.append(Node(tag, up, frozenset(marks), up.inherited | marks))
        self.hidden += tag in HIDDEN
        self.in_link += tag == "a"

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCK:
            self.handle_endtag(tag)

    def close(self, tag: str, stop: set[str] | frozenset[str] = frozenset(("article", "section", "div", "td", "li", "body", "blockquote", "aside", "main", "nav", "footer", "header", "form"))) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                self.cut(i)
                return
            if self.open[i].tag in stop:
                return

    def cut(self, i: int) -> None:
        for x in self.open[i:]:
            self.hidden -= x.tag in HIDDEN
            self.in_link -= x.tag == "a"
        del self.open[i:]

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.end_block()
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                self.cut(i)
                return
            if tag not in BLOCK and self.open[i].tag in BLOCK:
                return

    def handle_data(self, data: str) -> None:
        if self.node.tag == "head" and data.strip(" \t\n\f\r"):
            self.leave_head()
        if self.hidden:
            return
        self.parts.append(data)
        if self.in_link:
            self.links += len(SPACES.sub("", data))
        self.seen.add(self.node.tag)


def features(b: Block) -> dict[str, float]:
    """The features of a block by name."""
    marks, tags = b.node.inherited, set()
    x: Node | None = b.node
    while x is not None and len(tags) < 8:
        tags.add(x.tag)
        x = x.parent
    chars = len(b.text.replace(" ", ""))
    words = b.text.count(" ") + 1
    f = {
        "start": 1.0, "content_element": "content_element" in marks, "boilerplate_element": "boilerplate_element" in marks, "boilerplate_name": "boilerplate_name" in marks, "hidden": "hidden" in marks,
        "content_name": "content_name" in marks, "paragraph": bool(tags & {"p", "pre", "blockquote"}), "heading": bool(tags & HEADINGS), "list_item": "li" in tags,
        "link_share": min(1.0, b.link_chars / max(1, chars)), "words": min(4.0, words / 10), "sentence": bool(SENTENCE_END.search(b.text)), "copyright": bool(COPYRIGHT.search(b.text)),
    }
    return {k: float(v) for k, v in f.items()}


def weak_label(f: dict[str, float]) -> bool | None:
    """What the markup says of a block: content, boilerplate, or nothing (None)."""
    if f["boilerplate_element"] or f["boilerplate_name"] or f["hidden"]:
        return False
    return True if f["content_element"] else None


def labelled_blocks(html: str | None) -> list[tuple[bool, list[float]]]:
    """Label and text features (in the order of TEXT) of the blocks of a page that its markup labels."""
    found = [features(b) for b in blocks_of(html)]
    return [(y, [f[k] for k in TEXT]) for f in found if (y := weak_label(f)) is not None]


def fit(x: np.ndarray, y: np.ndarray, steps: int = 25) -> dict[str, float]:
    """Weights of all features: those of the text by logistic regression (Newton's steps, both labels weighing the same), those of the place as given.

    x: rows of text features in the order of TEXT, y: 1 for content. With fewer than LEAST_BLOCKS rows of a label it is WEIGHTS.
    """
    n_pos, n_neg = int(y.sum()), int(len(y) - y.sum())
    if min(n_pos, n_neg) < LEAST_BLOCKS:
        return WEIGHTS
    share, w = np.where(y > 0, 0.5 / n_pos, 0.5 / n_neg), np.zeros(x.shape[1])
    penalty = RIDGE * np.eye(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (share * (p - y)) + penalty @ w
        w = w - np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + penalty, slope)
    return PLACE | dict(zip(TEXT, w.tolist(), strict=True))


def fitted(df: DataFrame, id_col: str = "page_id", html: str = "html", pages: int = SAMPLE_PAGES) -> dict[str, float]:
    """Weights fitted on the labelled blocks of at most `pages` of df's pages (by the lowest hashes of their ids). Pages are parsed on the executors; rows of numbers reach the driver."""
    keyed = df.select(F.xxhash64(id_col).alias("h"), F.col(html).alias("html"))
    chosen = keyed.select("h").distinct().orderBy("h").limit(pages)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(float(y), x) for t in pdf["html"] for y, x in labelled_blocks(t)], columns=["y", "x"])

    rows = keyed.join(F.broadcast(chosen), "h").dropDuplicates(["h"]).select("html").mapInPandas(run, "y double, x array<double>").toPandas()
    rows = rows.assign(key=rows["x"].map(tuple)).sort_values(["y", "key"])  # sums don't depend on the order that rows come in
    return fit(np.array(rows["key"].tolist(), float).reshape(len(rows), len(TEXT)), rows["y"].to_numpy(float))


def classify(b: Block, weights: dict[str, float] = WEIGHTS) -> float:
    """The classifier's sum for a block: over 0 for content. Its parts over and under 0 are the costs of the other label."""
    return sum(weights.get(k, 0.0) * v for k, v in features(b).items())


def minimum_cut(n: int, source: list[int], sink: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which of n vertices stay with the source in a minimum cut: level graphs and blocking flows (Dinic), without recursion.

    source, sink: capacities from the source to each vertex and from it to the sink; edges go both ways.
    """
    s, t = n, n + 1
    to: list[int] = []
    cap: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def add(a: int, b: int, c: int, back: int) -> None:
        out[a].append(len(to))
        to.append(b)
        cap.append(c)
        out[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i in range(n):
        # what flows straight through a vertex needs no search
        least = min(source[i], sink[i])
        if source[i] > least:
            add(s, i, source[i] - least, 0)
        if sink[i] > least:
            add(i, t, sink[i] - least, 0)
    for a, b, c in edges:
        add(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if cap[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        at = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                k = next(i for i, e in enumerate(path) if not cap[e])
                a = to[path[k] ^ 1]
                del path[k:]
                continue
            while at[a] < len(out[a]):
                e = out[a][at[a]]
                if cap[e] and level[to[e]] == level[a] + 1:
                    break
                at[a] += 1
            if at[a] < len(out[a]):
                path.append(out[a][at[a]])
                a = to[path[-1]]
            elif path:
                a = to[path.pop() ^ 1]
                at[a] += 1
            else:
                break


def blocks_of(html: str | None) -> list[Block]:
    p = Blocks()
    p.feed(html or "")
    p.close_all()
    return p.blocks


def labelled(html: str | None, weights: dict[str, float] = WEIGHTS) -> list[tuple[str, bool]]:
    """The text of each block of a page and whether it is content."""
    blocks = blocks_of(html)
    sums = [classify(b, weights) for b in blocks]
    source = [round(SCALE * max(0.0, x)) for x in sums]
    sink = [round(SCALE * max(0.0, -x)) for x in sums]
    edges, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, round(SCALE * NEXT)))
        for up, weight in ((b.node.parent, SAME_PARENT), (b.node.parent.parent if b.node.parent else None, SAME_GRANDPARENT)):
            if up is not None and up.tag not in ("", "html", "body"):
                j = last.get((id(up), weight))
                if j is not None:
                    edges.append((j, i, round(SCALE * weight)))
                last[id(up), weight] = i
    return [(b.text, kept) for b, kept in zip(blocks, minimum_cut(len(blocks), source, sink, edges), strict=True)]


def _close_all(self: Blocks) -> None:
    """Ends the page: what is left unread is text (an open tag at its end is not)."""
    rest = self.rawdata
    if rest and not rest.lstrip().startswith("<"):
        self.handle_data(rest)
    self.end_block()


Blocks.close_all = _close_all


def main_text(html: str | None, weights: dict[str, float] = WEIGHTS) -> str:
    """The content blocks of a page, joined by line ends."""
    return "\n".join(t for t, kept in labelled(html, weights) if kept)


def extract(df: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", weights: dict[str, float] | None = None) -> DataFrame:
    """Per row: id, url, text (the main text of the whole html; empty if there is none), n_chars (its code points).

    Null html is empty. White space in a block is one space; blocks are joined by one line end. Markup that isn't closed is
    read as browsers do. Without weights, those are fitted first, see fitted(). Repeated rows get a row each. An empty table gives an empty result. Other columns are not read.
    """

    if weights is None:
        weights = fitted(df, id_col, html)

    def run(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in pages:
            texts = [main_text(x, weights) for x in batch]
            yield pd.DataFrame({"text": texts, "n_chars": [len(x) for x in texts]})

    made = F.pandas_udf(run, "text string, n_chars long")
    out = df.select(F.col(id_col).alias("id"), F.col(url).alias("url"), made(F.col(html)).alias("made"))
    return out.select(F.col("id").alias(id_col), "url", "made.*")
