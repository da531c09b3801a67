"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into blocks of text.  A logistic classifier, trained here on pages
made by :func:`sample_pages`, gives each block the cost of calling it content and
of calling it boilerplate; these are the capacities to the two terminals.
Smoothness edges join blocks that follow each other, stronger the closer they are
in the tree, and each block with the one before it under the same parent.  The
minimum cut, found by augmenting flows, separates content from boilerplate.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.llm.common import columns_of, id_type, python_ready

# Names of HTML elements and the words that name parts of a page in class, id and role.
RAW = frozenset("script style template textarea title svg select head annotation annotation-xml".split())
#: Shown only where something else is not: the cut decides.
INSTEAD = frozenset("noscript object canvas iframe audio video".split())
MATH = frozenset(
    "maction math menclose merror mfenced mfrac mi mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
) | MATH
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
ASIDE = frozenset("nav footer aside form menu button dialog fieldset legend option".split())
MAIN = frozenset("article main".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline consent cookie cookies disclaimer footer gdpr header "
    "login masthead menu modal nav navbar navigation newsletter notice outbrain pager pagination popup promo promotion related rail recommended "
    "search share sharing shoutbox sidebar sidebars signup skip social sponsor sponsored subscribe tags toolbar topbar widget widgets".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist commenter reply replies respond discussion disqus feedback".split())
MAIN_WORDS = frozenset("article articlebody body content entry entrycontent hentry main maincontent post postcontent story text".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Farther apart in the tree makes no difference.
FAR = 64
NAMES = ("words", "link", "sentence", "aside_tag", "aside_word", "comment", "main_tag", "main_word", "heading", "header", "listed", "hidden", "one")


@dataclass
class Node:
    """An open element and what its ancestors make of it."""

    tag: str
    parent: Node | None
    depth: int = 0
    flags: frozenset[str] = frozenset()


@dataclass
class Block:
    """A run of text between block boundaries."""

    node: Node
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    def text(self) -> str:
        return " ".join(html.unescape("".join(self.parts)).split())


def _flags(tag: str, attributes: str, parent: Node | None) -> frozenset[str]:
    flags = set(parent.flags) if parent else set()
    inside = "main_tag" in flags
    if tag in MAIN:
        flags.add("main_tag")
    if tag in ASIDE and not (tag in ("header",) and inside):
        flags.add("aside_tag")
    if tag in INSTEAD:
        flags.add("hidden")
    if tag == "header" and not inside:
        flags.add("header")
    if tag in ("li", "dt", "dd", "td", "th"):
        flags.add("listed")
    if re.fullmatch("h[1-6]", tag):
        flags.add("heading")
    if attributes and tag not in ("html", "body"):
        if HIDDEN.search(attributes):
            flags.add("hidden")
        for found in NAMED.findall(attributes):
            words = {p.lower() for p in PARTS.findall("".join(found))}
            if words & COMMENT_WORDS:
                flags.add("comment")
            elif words & ASIDE_WORDS:
                flags.add("aside_word")
            elif words & MAIN_WORDS:
                flags.add("main_word")
    return frozenset(flags)


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in order; text of scripts, styles, forms' lists and the head is no block."""
    root = Node("", None)
    node, blocks, block = root, [], None
    link: Node | None = None  # the element that an open link is in
    at, end = 0, len(page)

    def text(s: str) -> None:
        nonlocal block
        if block is None:
            if not s or s.isspace():
                return
            block = Block(node)
            blocks.append(block)
        block.parts.append(s)
        if link is not None:
            block.linked += len(s.strip())

    while at < end:
        m = TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in RAW and not closing:
            if not attributes.rstrip().endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}\b[^>]*>?" + ("|<body\\b" if tag == "head" else ""), re.I).search(page, at)
                at = end if not close else close.start() if close[0].lower().startswith("<body") else close.end()
            continue
        if tag == "br":
            text(" ")
            continue
        if tag == "a":
            link = None if closing else node
        if tag in INLINE or tag in VOID:
            if tag == "hr":
                block = None
            continue
        block = None
        if closing:
            up = node
            while up is not root and up.tag != tag:
                up = up.parent
            if up is not root:
                node = up.parent
                if link is not None and node.depth < link.depth:
                    link = None  # its element is closed, and the link with it
            continue
        if tag in CLOSES_P and node.tag == "p" or tag == node.tag and tag in ("li", "dt", "dd", "td", "th", "tr", "option"):
            node = node.parent
        node = Node(tag, node, node.depth + 1, _flags(tag, attributes, node))
    return [b for b in blocks if b.text()]


def _features(block: Block) -> tuple[float, ...]:
    text, flags = block.text(), block.node.flags
    letters = max(1, len(text))
    return (
        math.log1p(text.count(" ") + 1),
        min(1.0, block.linked / letters),
        float(text.rstrip("\"'”)").endswith((".", "!", "?", "…", ":"))),
        *(float(name in flags) for name in NAMES[3:12]),
        1.0,
    )


def _distance(a: Node, b: Node) -> int:
    """Edges between two elements of the tree, by way of their nearest common ancestor, counted up to ``FAR``."""
    steps = 0
    while a is not b and steps < FAR:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def min_cut(content: list[float], boilerplate: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each block is content in the labelling of least cost.

    ``content[i]`` and ``boilerplate[i]`` are the costs of either label, an edge's
    weight that of different labels at its ends.  Dinic's algorithm; blocks that
    no free edge joins to the source are boilerplate.
    """
    n = len(content)
    source, sink = n, n + 1
    head: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def join(a: int, b: int, forth: float, back: float) -> None:
        for u, v, w in ((a, b, forth), (b, a, back)):
            out[u].append(len(head))
            head.append(v)
            room.append(w)

    for i in range(n):
        shared = min(content[i], boilerplate[i])  # flows straight through
        join(source, i, boilerplate[i] - shared, 0.0)
        join(i, sink, content[i] - shared, 0.0)
    for a, b, w in edges:
        join(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for e in out[u]:
                if room[e] > 1e-12 and level[head[e]] < 0:
                    level[head[e]] = level[u] + 1
                    queue.append(head[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        place = [0] * (n + 2)
        path: list[int] = []
        u = source
        while True:
            if u == sink:
                push = min(room[e] for e in path)
                for e in path:
                    room[e] -= push
                    room[e ^ 1] += push
                # Go on from where the first full edge begins.
                full = next(i for i, e in enumerate(path) if room[e] <= 1e-12)
                u = head[path[full] ^ 1]
                del path[full:]
                continue
            while place[u] < len(out[u]):
                e = out[u][place[u]]
                if room[e] > 1e-12 and level[head[e]] == level[u] + 1:
                    break
                place[u] += 1
            if place[u] < len(out[u]):
                path.append(out[u][place[u]])
                u = head[path[-1]]
            elif u == source:
                break
            else:
                level[u] = -2
                e = path.pop()
                u = head[e ^ 1]


def sample_pages(n: int = 240, seed: int = 5) -> list[tuple[str, set[str]]]:
    """Pages with known content: (html, first words of the content blocks).  Many layouts, made-up words."""
    rng = random.Random(seed)
    pages = []
    for _ in range(n):
        kept: set[str] = set()
        count = 0

        def said(low: int, high: int, keep: bool, stop: bool = True, kept: set[str] = kept) -> str:
            nonlocal count
            count += 1
            first = f"w{count}x"
            if keep:
                kept.add(first)
            words = ["".join(rng.choices("abcdefghiklmnoprstuvz", k=rng.randint(2, 9))) for _ in range(rng.randint(low, high) - 1)]
            return " ".join([first, *words]) + ("." if stop else "")

        def menu(n: int) -> str:
            return "<ul>" + "".join(f'<li><a href="#">{said(1, 3, False, False)}</a></li>' for _ in range(n)) + "</ul>"

        named = lambda words: rng.choice(sorted(words))
        body = [f"<h1>{said(3, 10, True, rng.random() < 0.5)}</h1>"] if rng.random() < 0.8 else []
        for _ in range(rng.randint(1, 9)):
            body.append(rng.choice(["<p>{}</p>"] * 5 + ["<p><b>{}<br></p>", "<h2>{}</h2>", "<ul><li>{}</li></ul>", "<blockquote>{}</blockquote>"]).format(said(2, 60, True, rng.random() < 0.9)))
        if rng.random() < 0.3:
            body.insert(rng.randint(0, len(body)), f'<div class="{named(ASIDE_WORDS)}">{said(3, 20, False)}</div>')
        if rng.random() < 0.25:  # names mislead: a long paragraph of the article under the name of something else
            body.insert(rng.randint(0, len(body)), f'<div class="{named(ASIDE_WORDS)}"><p>{said(35, 90, True)}</p></div>')
        main = "".join(body)
        main = rng.choice([f"<article>{main}</article>"] * 3 + [f"<main>{main}</main>", f'<div class="{named(MAIN_WORDS)}">{main}</div>', f"<div>{main}</div>"])
        top = rng.choice(["<nav>{}</nav>", '<div class="nav">{}</div>', "<header>{}</header>", '<div id="menu">{}</div>']).format(menu(rng.randint(2, 8)))
        extra = [
            f'<div class="{named(ASIDE_WORDS)}">{said(3, 20, False)}</div>',
            f"<aside><h3>{said(1, 4, False, False)}</h3><p>{said(5, 30, False)}</p></aside>",
            f"<form><label>{said(1, 4, False, False)}</label><p>{said(2, 12, False)}</p></form>",
            f'<section id="{named(COMMENT_WORDS)}"><h3>{said(1, 3, False, False)}</h3>' + "".join(f'<div class="comment"><p>{said(3, 40, False)}</p></div>' for _ in range(rng.randint(1, 4))) + "</section>",
            f"<div>{menu(rng.randint(2, 6))}</div>",
        ]
        before, after = [e for e in extra[:3] if rng.random() < 0.35], [e for e in extra if rng.random() < 0.4]
        foot = rng.choice(["<footer>{}</footer>", '<div class="footer">{}</div>', "<footer><p>{}</p></footer>"]).format(said(3, 20, False))
        pages.append((f"<html><head><title>t</title></head><body>{top}{''.join(before)}{main}{''.join(after)}{foot}</body></html>", kept))
    return pages


@lru_cache(maxsize=1)
def classifier() -> tuple[float, ...]:
    """Weights by feature, fitted to the sample pages by Newton's method with a ridge."""
    rows, truth = [], []
    for page, kept in sample_pages():
        for block in blocks_of(page):
            rows.append(_features(block))
            truth.append(float(block.text().split(" ", 1)[0].rstrip(".") in kept))
    x, y = np.array(rows), np.array(truth)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + 0.3 * np.eye(x.shape[1])
        w += np.linalg.solve(hessian, x.T @ (y - p) - 0.3 * w)
    return tuple(w)


def main_text(page: str, weights: tuple[float, ...], adjacency: float = 1.0, sibling: float = 0.5) -> str:
    """Text of the content blocks, one to a line."""
    blocks = blocks_of(page)
    content, boilerplate, edges = [], [], []
    last: dict[int, int] = {}
    for i, block in enumerate(blocks):
        logit = max(-12.0, min(12.0, sum(a * b for a, b in zip(weights, _features(block), strict=True))))
        content.append(math.log1p(math.exp(-logit)))
        boilerplate.append(math.log1p(math.exp(logit)))
        if i:
            edges.append((i - 1, i, adjacency / (1 + _distance(blocks[i - 1].node, block.node))))
        parent = id(block.node.parent)
        if parent in last:
            edges.append((last[parent], i, sibling))
        last[parent] = i
    keep = min_cut(content, boilerplate, edges)
    return "\n".join(b.text() for b, k in zip(blocks, keep, strict=True) if k)


def _extract_batches(weights: tuple[float, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page or "", weights) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["id", "url", "text", "n_chars"],
            )

    return run


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: id, url, text, n_chars (code points).

    Null and empty pages, and those without content, give an empty text; ids keep
    their type, null ids and urls stay null; repeated rows each give a row.  Extra columns are ignored.
    """
    python_ready(pages.sparkSession)
    rows = columns_of(pages, id_col, url_col, html_col).select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").alias("html")
    )
    done = rows.mapInArrow(_extract_batches(classifier()), f"id {id_type(pages, id_col)}, url string, text string, n_chars long")
    return done.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
