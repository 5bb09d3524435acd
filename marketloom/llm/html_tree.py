"""Main text of web pages by a tree-structured graphical model.

A page becomes the tree of its block elements; inline elements belong to the text of their block.
Every node has a hidden label, content or not. Its own potential comes from a logistic model over the node's
features (tag, names, landmarks above it, length, link share, punctuation, place); a potential on each
parent-child edge says how labels agree, by kind of child. Sum-product messages go up from the leaves and down from the
root, which gives the exact marginals, and blocks of nodes with a content marginal of at least one
half are the text.

Training uses pages that mark their main part themselves (article, main). Nodes below the mark are content unless
an element for something else (navigation, advert, comments, ...) lies between; all others are not. Each node
is seen twice, the second time without its landmarks, so that the other features learn to
decide on pages without marks.

Cases: null, empty and text-free pages give an empty text; unclosed and stray tags are repaired as browsers do
in the common cases; a tag that the page's end cuts off is dropped; time grows with the page's length, whatever is in it; without labelled pages the fixed names alone decide; rows with
null or repeated ids are rows of their own; an empty table gives an empty table.
"""

from __future__ import annotations

import html
import math
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import arrow_rows, written

FEATURES = 1 << 14
#: Labelled pages the model is fitted on, at most: the ones whose ids hash lowest.
SAMPLE_PAGES = 2_000
#: Distinct (features, label) rows among their nodes that the fit takes, at most.
SAMPLE_ROWS = 50_000

# The element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style".split())
HIDDEN = frozenset("script style noscript template head title svg iframe canvas select option button textarea datalist".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
CLOSES_SELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BARRIERS = CLOSES_P - {"p"}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

# Landmarks and the names pages give to parts that are not the article.
MAIN_TAGS = frozenset("article main".split())
OTHER_TAGS = frozenset("nav header footer aside form menu dialog".split())
OTHER_NAMES = frozenset(
    "ad ads adv advert advertisement advertisements banner breadcrumb breadcrumbs comment comments cookie cookies disclaimer disqus footer header menu"
    " modal nav navbar navigation newsletter notice pagination popup promo promoted related respond share sharing sidebar social sponsor sponsored subscribe"
    " subscription toolbar widget".split()
)

# Runs are possessive, and every alternative ends at the end of the page: a page is read in one pass, however it is cut.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_NAMES = re.compile(r"[a-z]+")


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    names: tuple[str, ...] = ()
    hidden: bool = False
    runs: list[tuple[int, str]] = field(default_factory=list)  # (place in the page, text)
    text: int = 0  # characters
    linked: int = 0
    stops: int = 0  # sentence marks


def parse(page: str | None) -> list[Node]:
    """Block nodes in document order; a node's parent comes before it."""
    page = page or ""
    nodes = [Node("#page", -1)]
    open_: list[tuple[str, int]] = [("#page", 0)]  # (tag, block node) of open elements; "" for a closed inline one
    places: dict[str, list[int]] = {"#block": [0]}  # where the open elements of a tag or kind stand in it
    pieces: list[tuple[str, bool]] = []
    owner, place, links = 0, 0, 0

    def flush() -> None:
        nonlocal pieces, place
        if pieces:
            text = " ".join("".join(p for p, _ in pieces).split())
            if text and not nodes[owner].hidden:
                node = nodes[owner]
                node.runs.append((place, text))
                node.text += len(text)
                node.linked += sum(len(p.strip()) for p, linked in pieces if linked)
                node.stops += sum(text.count(c) for c in ".!?")
                place += 1
            pieces = []

    def push(tag: str) -> None:
        for kind in (tag, "" if tag in INLINE else "#block", "#barrier" if tag in BARRIERS else ""):
            if kind:
                places.setdefault(kind, []).append(len(open_))
        open_.append((tag, owner))

    def top(*kinds: str) -> int:
        return max((places[k][-1] for k in kinds if places.get(k)), default=0)

    def pop_to(depth: int) -> None:
        nonlocal owner, links
        flush()
        for tag, _ in open_[depth:]:
            for kind in (tag, "" if tag in INLINE else "#block", "#barrier" if tag in BARRIERS else ""):
                if tag and kind:
                    places[kind].pop()
            links -= tag == "a"
        del open_[depth:]
        owner = open_[-1][1]

    at, size = 0, len(page)
    while at < size:
        found = _TOKEN.search(page, at)
        end = found.start() if found else size
        if end > at and not nodes[owner].hidden:
            pieces.append((html.unescape(page[at:end]), links > 0))
        if not found:
            break
        at = found.end()
        tag = (found[3] or "").lower()
        if found[1]:
            pieces.append((found[1], links > 0))
        if not tag:
            continue
        if found[2]:
            if tag in INLINE:
                # an inline end tag reaches no further than its block
                depth = top(tag)
                if depth > top("#block"):
                    links -= tag == "a"
                    places[tag].pop()
                    open_[depth] = ("", open_[depth][1])
            elif top(tag):
                pop_to(top(tag))
            continue
        if tag == "br":
            pieces.append((" ", False))
            continue
        if tag in CLOSES_P or tag in CLOSES_SELF:
            depth, barrier = (top("p"), top("#barrier")) if tag in CLOSES_P else (top(*CLOSES_SELF[tag]), top(*SCOPES[tag]))
            if depth > barrier:
                pop_to(depth)
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in INLINE:
            if found[4].endswith("/"):
                continue
            links += tag == "a"
            push(tag)
            continue
        flush()
        names = tuple(n for _, v in _ATTRIBUTE.findall(found[4]) for n in _NAMES.findall(v.lower())) if found[4] else ()
        nodes.append(Node(tag, owner, names, nodes[owner].hidden or tag in HIDDEN))
        owner = len(nodes) - 1
        push(tag)
        if tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else size
            pop_to(len(open_) - 1)
    flush()
    return nodes


def _length_class(n: int) -> int:
    return 0 if n == 0 else min(n.bit_length(), 12)


def features(nodes: list[Node]) -> tuple[list[list[str]], list[list[str]]]:
    """Per node its own features and those of the landmarks above it."""
    own, marks = [], []
    above: list[str] = []
    for i, node in enumerate(nodes):
        parent = nodes[node.parent] if node.parent >= 0 else None
        mark = above[node.parent] if parent else "none"
        if node.tag in MAIN_TAGS or node.tag in OTHER_TAGS:
            mark = node.tag
        elif any(n in OTHER_NAMES for n in node.names):
            mark = "named"
        above.append(mark)
        share = 4 * node.linked // node.text if node.text else 0
        own.append(
            [
                "bias",
                f"tag {node.tag}",
                f"length {_length_class(node.text)}",
                f"links {share}",
                f"stops {min(node.stops, 4)} {_length_class(node.text) // 3}",
                f"place {min(8 * i // max(1, len(nodes)), 7)}",
                *[f"name {n}" for n in set(node.names)],
            ]
        )
        marks.append([f"mark {mark}", f"mark {mark} {node.tag}"])
        if parent:
            marks[-1].append(f"under {parent.tag}")
    return own, marks


def hashed(names: list[str]) -> list[int]:
    return [zlib.crc32(n.encode()) % FEATURES for n in names]


def own_labels(nodes: list[Node]) -> list[int] | None:
    """Labels a page gives itself by its landmarks; None for a page without them."""
    if not any(n.tag in MAIN_TAGS for n in nodes):
        return None
    out, refused = [], []
    for node in nodes:
        inside = out[node.parent] if node.parent >= 0 else 0
        above = node.parent >= 0 and refused[node.parent]
        other = node.tag in OTHER_TAGS or any(n in OTHER_NAMES for n in node.names)
        if node.tag in MAIN_TAGS:
            inside = int(not above)
        elif other:
            inside = 0
        out.append(inside)
        refused.append(above or other)
    return out


def edge_kind(node: Node) -> int:
    """0: a plain child; 1: one that starts a part of another kind; 2: one that starts a main part."""
    if node.tag in MAIN_TAGS:
        return 2
    return int(node.tag in OTHER_TAGS or any(n in OTHER_NAMES for n in node.names))


@dataclass(frozen=True)
class TreeModel:
    weights: np.ndarray  # by feature class
    edges: np.ndarray  # log-potentials [kind, parent label, child label]

    def marginals(self, nodes: list[Node]) -> list[float]:
        """P(content) of every node, by one pass of messages up and one down."""
        own, marks = features(nodes)
        unary = [float(self.weights[hashed(a + b)].sum()) for a, b in zip(own, marks, strict=True)]
        edges = self.edges.tolist()
        kinds = [edge_kind(n) for n in nodes]
        # beliefs as (log-potential of other, of content)
        up0, up1 = [0.0] * len(nodes), unary[:]
        message0, message1 = [0.0] * len(nodes), [0.0] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):
            e = edges[kinds[i]]
            message0[i] = _add(e[0][0] + up0[i], e[0][1] + up1[i])
            message1[i] = _add(e[1][0] + up0[i], e[1][1] + up1[i])
            p = nodes[i].parent
            up0[p] += message0[i]
            up1[p] += message1[i]
        out0, out1 = up0[:], up1[:]
        for i in range(1, len(nodes)):
            p, e = nodes[i].parent, edges[kinds[i]]
            rest0, rest1 = out0[p] - message0[i], out1[p] - message1[i]
            out0[i] += _add(rest0 + e[0][0], rest1 + e[1][0])
            out1[i] += _add(rest0 + e[0][1], rest1 + e[1][1])
        return [1 / (1 + math.exp(max(-500.0, min(500.0, a - b)))) for a, b in zip(out0, out1, strict=True)]

    def text(self, page: str | None) -> str:
        nodes = parse(page)
        if not any(n.runs for n in nodes):
            return ""
        runs = [r for n, p in zip(nodes, self.marginals(nodes), strict=True) if p >= 0.5 for r in n.runs]
        return "\n".join(text for _, text in sorted(runs))


def _add(a: float, b: float) -> float:
    top, low = (a, b) if a > b else (b, a)
    return top + math.log1p(math.exp(low - top)) if top - low < 40 else top


def labelled_nodes(pages: DataFrame, html_col: str) -> DataFrame:
    """`features`, `label`, `kind`, `up` (the parent's label) of the nodes of labelled pages, with and without landmarks."""

    def rows(groups):
        for group in groups:
            made = []
            for (page,) in group:
                nodes = parse(page)
                labels = own_labels(nodes)
                if labels is None:
                    continue
                for i, (a, b) in enumerate(zip(*features(nodes), strict=True)):
                    up = labels[nodes[i].parent] if i else -1
                    made.append((sorted(set(hashed(a + b))), labels[i], edge_kind(nodes[i]), up))
                    made.append((sorted(set(hashed(a))), labels[i], 0, up))  # all edges are plain without landmarks
            yield made

    return arrow_rows(pages, [html_col], rows, "features array<int>, label int, kind int, up int")


#: P(child label | parent label) by kind of edge before any page is seen, and its weight in edges.
EDGE_PRIOR = np.array([[[0.95, 0.05], [0.05, 0.95]], [[0.98, 0.02], [0.95, 0.05]], [[0.1, 0.9], [0.1, 0.9]]])
EDGE_WEIGHT = 20.0


def fixed_weights() -> np.ndarray:
    """Weights of the fixed names before any page is seen."""
    weights = np.zeros(FEATURES)
    for mark, w in [*((f"mark {t}", 2.0) for t in MAIN_TAGS), *((f"mark {t}", -2.0) for t in OTHER_TAGS), ("mark named", -2.0), *((f"name {n}", -1.0) for n in OTHER_NAMES)]:
        weights[hashed([mark])] += w
    return weights


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample_pages: int = SAMPLE_PAGES) -> TreeModel:
    marked = F.coalesce(F.lower(F.col(html_col)).rlike("<(article|main)[ >/]"), F.lit(False))
    chosen = pages.filter(marked).select(F.col(id_col), F.xxhash64(F.col(html_col)).alias("_hash"))
    chosen = chosen.orderBy(F.xxhash64(F.col(id_col)), "_hash").limit(sample_pages).distinct()
    sample = pages.withColumn("_hash", F.xxhash64(F.col(html_col))).join(F.broadcast(chosen), [id_col, "_hash"], "left_semi")
    nodes = written(labelled_nodes(sample, html_col), "page-nodes")
    distinct = nodes.groupBy("features", "label").count().orderBy(F.xxhash64("features"), "label").limit(SAMPLE_ROWS)
    rows = distinct.toArrow().to_pydict()
    if not rows["label"]:
        return TreeModel(fixed_weights(), np.log(EDGE_PRIOR))
    pairs = {(r["kind"], r["up"], r["label"]): r["count"] for r in nodes.filter("up >= 0").groupBy("kind", "up", "label").count().collect()}
    counts = np.array([[[pairs.get((k, p, c), 0) for c in (0, 1)] for p in (0, 1)] for k in (0, 1, 2)]) + EDGE_WEIGHT * EDGE_PRIOR
    weights = _logistic(rows["features"], np.array(rows["label"]), np.sqrt(rows["count"]), fixed_weights())
    return TreeModel(weights, np.log(counts / counts.sum(2, keepdims=True)))


def _logistic(rows: list[list[int]], labels: np.ndarray, weights: np.ndarray, start: np.ndarray, steps: int = 300, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a logistic model over sparse 0/1 features, held towards `start`; accelerated gradient steps."""
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    column = np.concatenate([np.asarray(r, "int64") for r in rows])
    weights = weights / weights.sum()
    rate = 4.0 / max(len(r) for r in rows)
    now = ahead = start
    for step in range(steps):
        score = np.bincount(row, ahead[column], len(rows))
        error = weights * (1 / (1 + np.exp(-np.clip(score, -30, 30))) - labels)
        slope = np.bincount(column, error[row], FEATURES) + ridge * (ahead - start)
        after = ahead - rate * slope * 10
        ahead, now = after + step / (step + 3) * (after - now), after
    return now


def main_texts(pages: DataFrame, model: TreeModel, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """`page_id`, `url`, `text`, `n_chars` of every page."""
    sent = pages.sparkSession.sparkContext.broadcast(model)

    def rows(groups):
        extract = sent.value.text
        for group in groups:
            texts = [extract(page) for _, _, page in group]
            yield [(i, url, t, len(t)) for (i, url, _), t in zip(group, texts, strict=True)]

    return arrow_rows(pages, [id_col, url_col, html_col], rows, "page_id bigint, url string, text string, n_chars bigint", 64)
