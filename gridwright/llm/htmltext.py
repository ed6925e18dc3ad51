"""Main text of web pages: gradient-boosted trees over DOM nodes and a hierarchical decoding.

The trees learn from a bounded sample of the pages themselves. In a page that marks its article (``article``, ``main``,
``role=main``) the article's blocks and the rest are known; from these, training pages are set anew in many layouts, with
other tags, class names or none, and with menus, notices, adverts, forms, sidebars and reader comments from other pages,
also inside the article. So every node of a training page has a known label, and no single sign decides.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from html import escape

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.llm.dom import FEATURES, GROUPS, TAGS, Page, decode, features
from gridwright.llm.storage import stored

#: Pages the trees learn from at most, layouts made of each, trees and their depth.
SAMPLE_PAGES, LAYOUTS, TREES, DEPTH = 240, 6, 48, 5
PARSE_PAGES = 256  # pages whose nodes are held at once

_NAMES = list(GROUPS)
_ARTICLE = ("article", "main")


def article_blocks(page: Page) -> tuple[list[str], list[str]]:
    """Texts of the marked article (none if no article is marked) and of the rest."""
    inside, outside = [], []
    marked = [i for i, t in enumerate(page.tag) if t < len(TAGS) and TAGS[t] in _ARTICLE]
    ranges = [(i, page.end[i]) for i in marked]
    bad = [(i, page.end[i]) for i, t in enumerate(page.tag) if i and (t < len(TAGS) and TAGS[t] in ("nav", "header", "footer", "aside", "form") or page.groups[i] & ~(1 << _NAMES.index("content")))]
    for i, text in enumerate(page.text):
        if text:
            within = any(a <= i < b for a, b in ranges) and not any(a <= i < b for a, b in bad)
            (inside if within else outside).append(text)
    return inside, outside


def training_pages(blocks: list[str], rest: list[str], others: list[str], seed: int) -> list[str]:
    """Layouts of one page, each node marked with its label."""
    rng = random.Random(seed)
    pick = rng.choice
    others = others or rest or blocks

    def named(group: str, chance: float = 0.75) -> str:
        word = pick(GROUPS[group].split())
        return f' {pick(["class", "class", "id", "role"])}="{word}{pick(["", "", "-box", "_1", " wrap"])}"' if rng.random() < chance else ""

    def links(n: int) -> str:
        item = lambda: f'<li><a href="/x">{escape(" ".join(pick(others).split()[: rng.randint(1, 4)]))}</a></li>'
        return "<ul>" + "".join(item() for _ in range(n)) + "</ul>"

    def short(n: int = 16) -> str:
        return escape(" ".join(pick(others).split()[: rng.randint(1, n)]))

    def paragraphs(n: int) -> str:
        return "".join(f"<p>{escape(pick(others))}</p>" for _ in range(n))

    def boiler(kind: str) -> str:
        if kind == "menu":
            return pick([f"<nav data-y=0{named('menu', 0.3)}>{links(rng.randint(3, 10))}</nav>", f"<div data-y=0{named('menu')}>{links(rng.randint(3, 10))}</div>"])
        if kind == "header":
            return f"<{(t := pick(['header', 'div']))} data-y=0{named('header', 1 if t == 'div' else 0.4)}>{pick(['', '<h1>' + short(5) + '</h1>'])}<p>{short(8)}</p></{t}>"
        if kind == "footer":
            return f"<{(t := pick(['footer', 'div']))} data-y=0{named('footer', 1 if t == 'div' else 0.3)}>{pick(['', '<p>'])}&copy; {short(10)} {pick(['', links(3)])}</{t}>"
        if kind == "side":
            return f"<{(t := pick(['aside', 'div']))} data-y=0{named('side', 1 if t == 'div' else 0.3)}><h3>{short(3)}</h3>{pick([links(5), paragraphs(rng.randint(1, 3))])}</{t}>"
        if kind == "form":
            return f"<form data-y=0{named('form', 0.6)}><p>{short(12)}</p><label>{short(3)}</label><input name=q></form>"
        if kind == "comment":
            item = lambda: f"<div{named('comment')}><p>{short(4)}</p>{paragraphs(rng.randint(1, 2))}</div>"
            return f"<{(t := pick(['section', 'div']))} data-y=0{named('comment', 1)}>{pick(['', '<h3>' + short(2) + '</h3>'])}{''.join(item() for _ in range(rng.randint(1, 6)))}</{t}>"
        return f"<div data-y=0{named(kind, 1)}>{pick([short(20), '<p>' + short(30) + '</p>', links(3)])}</div>"

    def inline(text: str) -> str:
        """The text with a few of its words in links or emphasis, as articles have them."""
        parts = [escape(w) for w in text.split()]
        if len(parts) > 6 and rng.random() < 0.5:
            for _ in range(rng.randint(1, 4)):
                at, mark = rng.randrange(len(parts)), pick(["a", "a", "a", "em", "strong", "span"])
                if "<" not in parts[at]:
                    parts[at] = f"<{mark} href='/y'>{parts[at]}</{mark}>"
        return " ".join(parts)

    out = []
    for _ in range(LAYOUTS):
        tag, name = pick([("article", ""), ("article", named("content")), ("main", ""), ("div", named("content", 1)), ("section", named("content")), ("div", named("content", 0.5)), ("td", "")])
        body, head = [], True
        for text in blocks:
            body.append(f"<h1>{escape(text)}</h1>" if head and len(text) < 300 and rng.random() < 0.8 else f"{pick(['<p>', '<p>', '<p>', '<p><b>', '<blockquote>', '<div>'])}{inline(text)}")
            body[-1] += pick(["</p>", "", "</p>"]) if body[-1].startswith("<p>") else "</blockquote>" if body[-1].startswith("<blockquote>") else "</div>" if body[-1].startswith("<div>") else ""
            head = False
        if rng.random() < 0.3:
            body[0] = f"<header>{body[0]}{pick(['', '<p>' + short(6) + '</p>'])}</header>"
        for _ in range(rng.randint(0, 4)):  # subheadings, short paragraphs and lists are the article's too
            level = rng.randint(2, 4)
            items = "".join(f"<li>{short(pick([3, 30]))}</li>" for _ in range(rng.randint(1, 5)))
            body.insert(rng.randint(0, len(body)), pick([f"<h{level}>{short(8)}</h{level}>", f"<h{level}>{short(3)}</h{level}>", f"<ul>{items}</ul>", f"<p>{short(5)}</p>"]))
        for kind in rng.sample(["advert", "share", "form", "notice", "side", "comment"], rng.randint(0, 2)):
            body.insert(rng.randint(1, len(body)), boiler(kind))
        content = f"<{tag} data-y=1{name}>{''.join(body)}</{tag}>"
        content = f"<table><tr>{pick(['', '<td data-y=0>' + links(5) + '</td>'])}{content}</tr></table>" if tag == "td" else content
        if rng.random() < 0.4:
            content = f"<div{named('content', 0.4)}>{content}{pick(['', boiler('side')])}</div>"
        before = "".join(boiler(k) for k in rng.sample(["header", "menu", "advert", "notice", "form", "menu"], rng.randint(1, 4)))
        after = "".join(boiler(k) for k in rng.sample(["side", "comment", "share", "footer", "advert", "footer", "comment"], rng.randint(1, 4)))
        out.append(f"<html><body data-y=0>{before}{content}{after}</body></html>")
    return out


def _labelled_nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Feature rows and labels of the nodes of training pages. A node is positive if all its text is the article's."""
    for batch in batches:
        parsed = [article_blocks(Page(h)) for h in batch["html"]]
        every = [t for inside, outside in parsed for t in inside + outside]
        for (inside, outside), number in zip(parsed, batch["number"], strict=True):
            if not inside:
                continue
            rng = random.Random(int(number))
            pages = [Page(h) for h in training_pages(inside, outside, rng.sample(every, min(len(every), 60)), int(number))]
            rows, at, labels = features(pages), 0, []
            for p in pages:
                size = np.array([len(t) for t in p.text])
                total, mine = np.cumsum(np.append(0, size)), np.cumsum(np.append(0, size * (np.array(p.label) == 1)))
                end = np.array(p.end)
                end[0] = len(size)
                here = np.arange(len(size))
                labels.append(((mine[end] - mine[here] >= total[end] - total[here]) & (total[end] > total[here])).astype(float))
            y = np.concatenate(labels)
            yield pd.DataFrame({"x": list(rows.astype(float)), "label": y})


class Trees:
    """Boosted trees as arrays: for each tree feature, threshold, children and value of its nodes."""

    def __init__(self, trees: list[tuple[np.ndarray, ...]], weights: list[float]):
        self.trees, self.weights = trees, weights

    @classmethod
    def of(cls, model) -> Trees:
        found = []
        for tree in model.trees:
            rows: list[list[float]] = []

            def walk(node, rows=rows) -> int:
                at = len(rows)
                rows.append([-1, 0.0, 0, 0, float(node.prediction())])
                if node.subtreeDepth() > 0:
                    split = node.split()
                    rows[at][:2] = [split.featureIndex(), float(split.threshold())]
                    rows[at][2] = walk(node.leftChild())
                    rows[at][3] = walk(node.rightChild())
                return at

            walk(tree._call_java("rootNode"))
            table = np.array(rows)
            found.append((table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int), table[:, 4]))
        return cls(found, list(model.treeWeights))

    def probability(self, x: np.ndarray) -> np.ndarray:
        margin = np.zeros(len(x))
        rows = np.arange(len(x))
        for (feature, threshold, left, right, value), weight in zip(self.trees, self.weights, strict=True):
            at = np.zeros(len(x), int)
            for _ in range(DEPTH):
                f = feature[at]
                inner = f >= 0
                go = np.where(x[rows, np.maximum(f, 0)] <= threshold[at], left[at], right[at])
                at = np.where(inner, go, at)
            margin += weight * value[at]
        return 1 / (1 + np.exp(-2 * margin))


def fit_trees(pages: DataFrame, rows: int = SAMPLE_PAGES) -> Trees | None:
    """Trees learned from at most ``rows`` pages that mark their article; None if no page does."""
    marked = pages.where(F.col("html").rlike("(?i)<(article|main)[ >]"))
    sample = marked.select(F.xxhash64("html").alias("number"), "html").dropDuplicates(["number"]).orderBy("number").limit(rows)
    nodes = sample.repartition(4, "number").sortWithinPartitions("number").mapInPandas(_labelled_nodes, "x array<double>, label double")
    nodes = stored(nodes, "nodes").select(array_to_vector("x").alias("features"), "label")
    if nodes.select("label").distinct().count() < 2:
        return None
    return Trees.of(GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=11, maxBins=64).fit(nodes))


def page_text(html: str | None, trees: Trees | None) -> str:
    """The main text of one page."""
    return page_texts([html], trees)[0]


def page_texts(htmls: list[str | None], trees: Trees | None) -> list[str]:
    pages = [Page(h or "") for h in htmls]
    if trees is None:  # nothing to learn from: all text that is not markup
        return ["\n".join(t for t in p.text if t) for p in pages]
    p = trees.probability(features(pages))
    out, at = [], 0
    for page in pages:
        n = len(page.parent)
        out.append("\n".join(page.text[i] for i in decode(page, p[at : at + n])))
        at += n
    return out


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of (page_id, url, html).

    A null or empty page, and one without text, has the empty text. Repeated rows get equal results. If no page marks its
    article there is nothing to learn from, and all text outside scripts, styles and the head is taken. An empty table gives
    an empty table.
    """
    pages = pages.select("page_id", "url", "html")
    trees = fit_trees(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, PARSE_PAGES):
                part = batch.slice(lo, PARSE_PAGES)
                texts = page_texts(part.column("html").to_pylist(), trees)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
