"""Main text of web pages by a tree-structured graphical model.

Every element of the page is a node with one of four states: content, clutter made of links and
labels, clutter made of prose (comments, notices, adverts), or a mixture that holds both kinds.
Potentials join each node to its parent and to what it shows (its tag, the words of its class, id
and role, how much text it holds, how much of that is links). They are estimated from labelled
pages by counting, on top of prior shares that weigh as much as PSEUDO_NODES nodes. Sum-product
messages go up and down the tree; a block of text belongs to the page's main text if content is
the likeliest state of its node.

Labelled pages are pages that mark their main part themselves (article, main): at most max_pages,
chosen by a hash of id and page. A null page counts as empty; a page without text gives an empty
text. Repeated rows give equal results. An empty table gives an empty result, and without any
labelled page the prior shares alone decide. Columns other than those named are not read.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crestline.llm.shared import at_most, drawn, short_batches

MAX_PAGES = 2_000
#: Weight of the prior shares, in nodes of a state: the more labelled nodes, the less they count.
PSEUDO_NODES = 500
CONTENT, LINKS, MIXTURE, PROSE = 0, 1, 2, 3
#: A quote opens a value only after an equals sign, as in HTML; elsewhere it is a character like any other. No part gives back what it took.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+)>""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas audio video select textarea title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that an opening tag of the kind ends, if one of them is open.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS |= dict.fromkeys("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split(), {"p"})
#: Tags that stand for themselves among a node's features; others share one value.
TAGS = ("#root", "html", "head", "body", "main", "article", "section", "div", "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "table", "tr", "td", "th", "blockquote", "pre", "figure", "figcaption", "nav", "header", "footer", "aside", "form", "button", "fieldset", "details", "dialog", "address", "menu")
#: Words in class, id and role.
CLUTTER = re.compile(r"(?:^|[\s_-])(?:ads?|adv|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|sidebar|side|widget\w*|footer|foot|header|masthead|comments?|commentlist|disqus|replies|reply|respond|share|sharing|social|related|recommend\w*|cookies?|consent|gdpr|notice|popup|modal|overlay|newsletter|subscri\w*|signup|login|search\w*|form|toolbar|pagination|pager|tags?|meta|byline|copyright|legal|disclaimer|alert|banner|complementary|navigation|contentinfo|dialog)(?:$|[\s_-])", re.I)
MATTER = re.compile(r"(?:^|[\s_-])(?:article\w*|content|main|post|entry|story|text|body|prose|markdown)(?:$|[\s_-])", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

SIZES = (len(TAGS) + 1, 3, 6, 4, 3)


@dataclass
class Page:
    """Nodes in document order (parents first): parent, tag, hint (0 none, 1 clutter, 2 matter), own text length, link length; blocks: (node, text)."""

    parent: list[int]
    tag: list[str]
    hint: list[int]
    chars: list[int]
    linked: list[int]
    blocks: list[tuple[int, str]]


def _attributes(raw: str) -> tuple[int, bool]:
    hint, hidden = 0, False
    for name, a, b, c in ATTRIBUTE.findall(raw) if raw and not raw.isspace() else ():
        value, name = a or b or c, name.lower()
        if name in ("class", "id", "role"):
            if CLUTTER.search(value):
                hint = 1
            elif not hint and MATTER.search(value):
                hint = 2
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and HIDDEN.search(value):
            hidden = True
    return hint, hidden


def parse(source: str | None) -> Page:
    """Block elements as nodes; the text between block borders as blocks, references decoded and white space joined."""
    page = Page([-1], ["#root"], [0], [0], [0], [])
    links, pieces, linked, at = 0, [], 0, 0
    #: Open elements: tag, node of the text in them, whether they are hidden; how many are open by tag, and how many are hidden.
    stack, opened, hiding = [("#root", 0, False)], Counter(), 0
    #: A hidden inline element: tag, how many of the tag are open, elements open where it began.
    hushed: tuple[str, int, int] | None = None
    source = source or ""
    # no tag ends after the last of these, so none is sought there, and every search stops at a tag's end
    last = source.rfind(">") + 1

    def add(tag: str, hint: int) -> int:
        page.parent.append(stack[-1][1])
        page.tag.append(tag)
        page.hint.append(hint)
        page.chars.append(0)
        page.linked.append(0)
        return len(page.tag) - 1

    def close_block() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(pieces)).split())
        if text:
            node = stack[-1][1]
            if page.tag[node] in ("#root", "html", "body"):  # loose text is a paragraph of its own
                node = add("p", 0)
            page.chars[node] += len(text)
            page.linked[node] += min(linked, len(text))
            page.blocks.append((node, text))
        pieces.clear()
        linked = 0

    def pop() -> str:
        nonlocal hiding, hushed
        tag, _, hidden = stack.pop()
        opened[tag] -= 1
        hiding -= hidden
        if hushed and len(stack) < hushed[2]:  # never closed, but what holds it is
            hushed = None
        return tag

    while at < len(source):
        found = TOKEN.search(source, at, last) if at < last else None
        if not (hiding or hushed) and (text := source[at : found.start() if found else len(source)]):
            pieces.append(text)
            if links:
                linked += len(text)
        if not found:
            break
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        closing = bool(found[1])
        if tag in RAW:
            if not closing and not found[3].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
                at = end.end() if end else len(source)
            pieces.append(" ")
        elif tag == "br":
            pieces.append(" ")
        elif tag in VOID:
            if tag == "hr":
                close_block()
        elif tag in INLINE:
            if tag == "a":
                links = max(0, links - 1) if closing else 1
            if hushed:
                if tag == hushed[0]:
                    depth = hushed[1] + (-1 if closing else 1)
                    hushed = (tag, depth, hushed[2]) if depth else None
            elif not closing and not hiding and _attributes(found[3])[1]:
                hushed = tag, 1, len(stack)
        elif closing:
            if opened[tag]:
                close_block()
                links = 0
                while pop() != tag:
                    pass
        else:
            hint, hidden = _attributes(found[3])
            close_block()
            links = 0
            ended = ENDS.get(tag)
            if ended and stack[-1][0] in ended:
                pop()
                if tag == "tr" and stack[-1][0] == "tr":
                    pop()
            if found[3].endswith("/"):
                continue
            # hidden elements, and all in them, are open but no nodes
            stack.append((tag, stack[-1][1] if hidden or hiding or hushed else add(tag, hint), hidden))
            opened[tag] += 1
            hiding += hidden
    close_block()
    return page


def observed(page: Page) -> np.ndarray:
    """Codes of each node's features: tag, hint, own text, share of links in the text below, lines that look like sentences."""
    at = {t: k for k, t in enumerate(TAGS)}
    below, linked = list(page.chars), list(page.linked)
    for k in range(len(page.parent) - 1, 0, -1):
        below[page.parent[k]] += below[k]
        linked[page.parent[k]] += linked[k]
    stops = [0] * len(page.parent)
    for node, text in page.blocks:
        stops[node] = max(stops[node], 1 + (text[-1:] in ".!?\"'”’…" and len(text) > 40))
    size = lambda n: 0 if not n else min(5, 1 + int(math.log(n, 5)))
    share = lambda n, m: 0 if not m else min(3, 1 + int(3 * n / m))
    return np.array([(at.get(t, len(TAGS)), h, size(c), share(x, b), s) for t, h, c, x, b, s in zip(page.tag, page.hint, page.chars, linked, below, stops, strict=True)], np.int64)


CLUTTER_TAGS = frozenset(("nav", "header", "footer", "aside", "form", "button", "dialog", "menu", "fieldset", "head"))


def labelled(page: Page) -> list[int] | None:
    """States of the nodes of a page that marks its main part with article or main; None for others."""
    if not {"article", "main"} & {*page.tag}:
        return None
    marked = "main" if "main" in page.tag and "article" not in page.tag else "article"
    states = [LINKS] * len(page.tag)
    inside = [False] * len(page.tag)
    for k in range(1, len(page.tag)):
        clutter = page.tag[k] in CLUTTER_TAGS or page.hint[k] == 1
        inside[k] = not clutter and (page.tag[k] == marked or inside[page.parent[k]])
    prose = [False] * len(page.tag)
    for node, text in page.blocks:
        prose[node] |= 2 * page.linked[node] < page.chars[node] and len(text) > 20
    holds = list(inside)
    for k in range(len(page.tag) - 1, 0, -1):
        holds[page.parent[k]] |= holds[k]
        prose[page.parent[k]] |= prose[k]
    for k in range(len(page.tag)):
        states[k] = CONTENT if inside[k] else MIXTURE if holds[k] else PROSE if prose[k] else LINKS
    return states


def prior_shares() -> tuple[np.ndarray, list[np.ndarray]]:
    """What is believed before any page is seen: parent by child state, and for each feature state by value (rows: content, links, mixture, prose)."""
    edges = np.array([[0.70, 0.08, 0.005, 0.215], [0.002, 0.98, 0.002, 0.016], [0.3, 0.25, 0.2, 0.25], [0.002, 0.1, 0.002, 0.896]])
    at = {t: k for k, t in enumerate(TAGS)}
    tags = np.full((4, SIZES[0]), 1.0)
    for t, shares in {
        "p": (40, 10, 0.1, 30), "div": (12, 20, 30, 25), "section": (4, 3, 10, 4), "article": (6, 0.1, 3, 0.1), "main": (5, 0.02, 8, 0.02), "li": (6, 40, 0.3, 6), "ul": (3, 15, 0.5, 3),
        **dict.fromkeys(("h1", "h2", "h3", "h4"), (4, 3, 0.2, 3)), **dict.fromkeys(("#root", "html", "body"), (3, 1, 20, 0.5)), **dict.fromkeys(("nav", "menu", "button"), (0.02, 15, 0.05, 2)),
        **dict.fromkeys(("aside", "footer", "form", "dialog", "fieldset"), (0.03, 8, 0.05, 10)), "head": (0.02, 10, 0.02, 0.1), "header": (0.5, 10, 0.5, 6),
    }.items():
        tags[:, at[t]] = shares
    hints = np.array([[0.93, 0.0007, 0.07], [0.7, 0.29, 0.01], [0.83, 0.01, 0.16], [0.6, 0.39, 0.01]])
    sizes = np.array([[0.1, 0.05, 0.1, 0.2, 0.25, 0.3], [0.3, 0.25, 0.25, 0.15, 0.04, 0.01], [0.9, 0.03, 0.03, 0.02, 0.01, 0.01], [0.1, 0.05, 0.1, 0.2, 0.25, 0.3]])
    linked = np.array([[0.1, 0.8, 0.08, 0.02], [0.35, 0.05, 0.1, 0.5], [0.1, 0.5, 0.3, 0.1], [0.1, 0.75, 0.1, 0.05]])
    sentences = np.array([[0.2, 0.2, 0.6], [0.4, 0.55, 0.05], [0.9, 0.05, 0.05], [0.2, 0.25, 0.55]])
    return edges, [t / t.sum(1, keepdims=True) for t in (tags, hints, sizes, linked, sentences)]


#: Weight of each feature's evidence: those of the text agree by nature and would count twice.
TRUST = (1.0, 1.0, 0.4, 1.0, 0.4)


@dataclass
class TreeModel:
    """Logarithms of the potentials."""

    edges: np.ndarray
    features: list[np.ndarray]


def fit(pages: list[tuple[list[int], np.ndarray, list[int]]]) -> TreeModel:
    """From (parents, feature codes, states) of labelled pages."""
    edges, tables = np.zeros((4, 4)), [np.zeros((4, n)) for n in SIZES]
    for parents, codes, states in pages:
        y = np.array(states)
        np.add.at(edges, (y[np.array(parents[1:], np.int64)], y[1:]), 1)
        for t, c in zip(tables, codes.T, strict=True):
            np.add.at(t, (y, c), 1)
    # clutter made of prose looks like content but for tags and hints; pages with little of it would teach otherwise
    share = lambda x: x / max(1.0, x.sum())
    tables[0][PROSE] = share(tables[0][PROSE]) + share(tables[0][CONTENT])
    tables[0][PROSE, [TAGS.index("article"), TAGS.index("main")]] = 0
    for t in tables[2:]:
        t[PROSE] = t[CONTENT]
    prior_edges, prior_tables = prior_shares()

    def learned(counts: np.ndarray, prior: np.ndarray) -> np.ndarray:
        return (counts + PSEUDO_NODES * prior) / (counts.sum(1, keepdims=True) + PSEUDO_NODES)

    return TreeModel(np.log(learned(edges, prior_edges)), [w * np.log(learned(t, p)) for w, t, p in zip(TRUST, tables, prior_tables, strict=True)])


def marginals(parents: np.ndarray, depth: np.ndarray, codes: np.ndarray, model: TreeModel) -> np.ndarray:
    """Log marginals (not normalised) of a forest's nodes: messages go up by levels, then down."""
    lse = lambda x, axis: (m := x.max(axis=axis, keepdims=True), np.squeeze(m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True)), axis))[1]
    belief = sum(t[:, c].T for t, c in zip(model.features, codes.T, strict=True))
    up = np.zeros_like(belief)
    order = np.argsort(depth, kind="stable")
    levels = np.split(order, np.searchsorted(depth[order], np.arange(1, depth.max() + 1))) if len(depth) else []
    for nodes in reversed(levels[1:]):
        up[nodes] = lse(model.edges[None] + belief[nodes][:, None, :], 2)
        np.add.at(belief, parents[nodes], up[nodes])
    for nodes in levels[1:]:
        rest = belief[parents[nodes]] - up[nodes]
        belief[nodes] += lse(model.edges[None] + rest[:, :, None], 1)
    return belief


def extract(sources: list[str | None], model: TreeModel) -> list[str]:
    """Main texts of pages, whose trees are one forest."""
    pages = [parse(x) for x in sources]
    if not pages:
        return []
    first = np.cumsum([0, *(len(p.tag) for p in pages)])
    parents = np.concatenate([np.array(p.parent) + k for p, k in zip(pages, first, strict=False)])
    depth = np.zeros(len(parents), np.int64)
    for p, k in zip(pages, first.tolist(), strict=False):
        own = [0] * len(p.tag)
        for j in range(1, len(own)):
            own[j] = own[p.parent[j]] + 1
        depth[k : k + len(own)] = own
    best = marginals(parents, depth, np.concatenate([observed(p) for p in pages]), model).argmax(axis=1)
    return ["\n\n".join(t for node, t in p.blocks if best[k + node] == CONTENT) for p, k in zip(pages, first.tolist(), strict=False)]


def train(pages: DataFrame, page: str = "html", max_pages: int = MAX_PAGES, id_col: str = "page_id") -> TreeModel:
    """Fits the potentials on at most max_pages pages that mark their main part. Their trees, not their texts, reach the driver."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(page).alias("h")).where(F.lower("h").rlike("<(article|main)[\\s>]"))
    short_batches(pages.sparkSession)

    @F.pandas_udf("struct<parents:array<int>,codes:array<array<int>>,states:array<int>>")
    def trees(part: pd.Series) -> pd.DataFrame:
        out = []
        for x in part:
            p = parse(x)
            states = labelled(p)
            out.append((p.parent, observed(p).tolist(), states) if states else ([], [], []))
        return pd.DataFrame(out, columns=["parents", "codes", "states"])

    made = drawn(rows, max_pages, "id", "h").select("_draw", trees("h").alias("t")).select("_draw", "t.*").where(F.size("states") > 0)
    got = at_most(made, max_pages).collect()
    return fit([(list(r["parents"]), np.array([list(c) for c in r["codes"]], np.int64), list(r["states"])) for r in got])


def main_text(page: Column, model: TreeModel, df: DataFrame) -> Column:
    spark = df.sparkSession
    short_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def text(part: pd.Series) -> pd.Series:
        return pd.Series(extract(part.tolist(), shared.value), dtype=object)

    return text(page)
