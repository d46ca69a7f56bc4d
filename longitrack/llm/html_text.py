"""Main text of HTML pages: flat text blocks classified by a decision tree.

A page becomes a flat list of text blocks. A block is described by its own and its neighbours' word count
and link density and by what encloses it. A decision tree, grown on the small labelled table below, tells
content from the rest.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

# Comments, declarations and tags; a tag ends at the first > outside quotes.
MARKUP = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|aria-label|itemprop|hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
# Elements whose content is no text, and elements that stay inside a line of text.
SILENT = frozenset("script style noscript template textarea select option svg math iframe object head title button datalist canvas audio video".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
APART = frozenset("nav footer aside form dialog menu".split())
MAIN = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words in class, id or role that mark an element as no content. Whole words, or the word with a number.
HINTS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|adbox|adsense|banner|sponsor|sponsored|promo|promotion|cookie|cookies|consent|gdpr|notice|"
    r"alert|popup|modal|overlay|sidebar|side|menu|nav|navbar|navigation|breadcrumb|breadcrumbs|footer|masthead|topbar|header|toolbar|pagination|pager|"
    r"comment|comments|commentlist|reply|replies|respond|disqus|discussion|reactions|share|sharing|social|related|recommended|recommendations|newsletter|"
    r"subscribe|subscription|signup|login|search|widget|tags|complementary|contentinfo|hidden|copyright|legal|paywall|teaser|outbrain|taboola)(?:\d*)(?=$|[\s_-])", re.I)
FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "apart", "main", "heading")
# The labelled table. Features in the order above, then whether the block is content.
LABELLED = (
    # Menus, footers, asides, forms and elements with telling names, wherever they are.
    (1, 1.0, 0, 0.0, 1, 1.0, 1, 0, 0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 1, 0, 0, 0), (2, 1.0, 1, 1.0, 9, 0.0, 1, 0, 0, 0),
    (9, 0.0, 1, 1.0, 12, 0.0, 1, 0, 0, 0), (14, 0.0, 60, 0.0, 0, 0.0, 1, 0, 0, 0), (40, 0.0, 80, 0.0, 30, 0.0, 1, 0, 0, 0),
    (90, 0.1, 70, 0.0, 40, 0.0, 1, 0, 0, 0), (25, 0.0, 100, 0.0, 25, 0.0, 1, 1, 0, 0), (60, 0.0, 25, 0.0, 60, 0.0, 1, 1, 0, 0),
    (3, 0.0, 60, 0.0, 25, 0.0, 1, 1, 1, 0), (4, 1.0, 50, 0.0, 5, 1.0, 1, 1, 0, 0), (12, 0.2, 0, 0.0, 80, 0.0, 1, 0, 1, 0),
    (120, 0.0, 30, 0.0, 120, 0.0, 1, 0, 0, 0), (200, 0.0, 90, 0.0, 0, 0.0, 1, 1, 0, 0), (6, 0.5, 3, 1.0, 6, 0.5, 1, 0, 0, 0),
    # The article, its headings, short and long paragraphs, lists and lines full of links.
    (12, 0.0, 9, 0.0, 80, 0.0, 0, 1, 1, 1), (2, 0.0, 1, 1.0, 1, 0.0, 0, 1, 1, 1), (80, 0.0, 12, 0.0, 60, 0.0, 0, 1, 0, 1),
    (150, 0.05, 80, 0.0, 90, 0.0, 0, 1, 0, 1), (1, 0.0, 80, 0.0, 90, 0.0, 0, 1, 0, 1), (2, 0.0, 1, 0.0, 1, 0.0, 0, 1, 0, 1),
    (1, 0.0, 2, 0.0, 14, 0.0, 0, 1, 0, 1), (40, 0.0, 30, 0.0, 14, 0.0, 0, 1, 0, 1), (6, 1.0, 80, 0.0, 60, 0.0, 0, 1, 0, 1),
    (10, 0.6, 40, 0.0, 50, 0.1, 0, 1, 0, 1), (3, 0.0, 1, 1.0, 2, 1.0, 0, 1, 0, 1), (25, 0.0, 0, 0.0, 0, 0.0, 0, 1, 0, 1),
    (4, 0.0, 60, 0.0, 2, 0.0, 0, 1, 0, 1), (17, 0.0, 17, 0.0, 3, 0.0, 0, 1, 0, 1), (5, 1.0, 4, 1.0, 4, 1.0, 0, 1, 0, 1),
    (3, 1.0, 20, 0.0, 0, 0.0, 0, 1, 0, 1), (2, 0.0, 3, 0.0, 2, 0.0, 0, 1, 0, 1), (15, 0.0, 5, 0.0, 1, 1.0, 0, 1, 0, 1),
    (9, 0.0, 2, 1.0, 0, 0.0, 0, 1, 1, 1), (19, 0.9, 12, 0.0, 4, 0.0, 0, 1, 0, 1), (1, 0.0, 9, 0.0, 0, 0.0, 0, 1, 0, 1),
    (30, 0.8, 15, 0.7, 30, 0.9, 0, 1, 0, 1), (7, 0.0, 0, 0.0, 4, 0.0, 0, 1, 1, 1), (50, 0.0, 7, 0.0, 3, 0.0, 0, 1, 0, 1),
    # Pages without such elements: long text with few links, and headings and short lines next to it.
    (60, 0.0, 50, 0.0, 70, 0.0, 0, 0, 0, 1), (120, 0.1, 3, 1.0, 80, 0.0, 0, 0, 0, 1), (35, 0.0, 40, 0.0, 2, 1.0, 0, 0, 0, 1),
    (8, 0.0, 2, 1.0, 60, 0.0, 0, 0, 1, 1), (6, 0.0, 50, 0.0, 70, 0.0, 0, 0, 1, 1), (5, 0.0, 60, 0.0, 70, 0.0, 0, 0, 0, 1),
    (20, 0.1, 30, 0.0, 45, 0.0, 0, 0, 0, 1), (12, 0.0, 40, 0.0, 6, 0.0, 0, 0, 0, 1), (25, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1),
    (2, 1.0, 3, 1.0, 2, 1.0, 0, 0, 0, 0), (4, 1.0, 60, 0.0, 3, 1.0, 0, 0, 0, 0), (8, 0.8, 5, 0.9, 40, 0.0, 0, 0, 0, 0),
    (3, 0.0, 2, 1.0, 2, 1.0, 0, 0, 0, 0), (5, 0.0, 4, 0.6, 3, 0.0, 0, 0, 0, 0), (30, 0.7, 20, 0.8, 15, 0.5, 0, 0, 0, 0),
    (6, 0.0, 3, 1.0, 0, 0.0, 0, 0, 0, 0), (2, 0.0, 4, 0.0, 3, 1.0, 0, 0, 0, 0), (15, 0.9, 70, 0.0, 60, 0.0, 0, 0, 0, 0),
    (6, 0.0, 0, 0.0, 2, 1.0, 0, 0, 1, 0), (10, 0.5, 0, 0.0, 3, 1.0, 0, 0, 0, 0), (4, 0.0, 12, 0.6, 10, 0.9, 0, 0, 0, 0),
    (9, 0.0, 5, 0.8, 2, 0.0, 0, 0, 0, 0), (7, 0.3, 2, 1.0, 8, 0.4, 0, 0, 0, 0), (3, 0.0, 7, 0.0, 6, 0.5, 0, 0, 0, 0),
)
LEAST_ROWS = 1
MAX_DEPTH = 8


class Tree:
    """Binary tree by Gini impurity; splits lie half-way between neighbouring values."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, depth: int = MAX_DEPTH):
        self.content, self.feature = bool(labels.mean() > 0.5), None
        best = self.impurity(labels)
        if not depth or best == 0:
            return
        for feature in range(rows.shape[1]):
            values = np.unique(rows[:, feature])
            for limit in (values[:-1] + values[1:]) / 2:
                low = rows[:, feature] <= limit
                if min(low.sum(), (~low).sum()) < LEAST_ROWS:
                    continue
                cost = low.mean() * self.impurity(labels[low]) + (~low).mean() * self.impurity(labels[~low])
                if cost < best - 1e-12:
                    best, self.feature, self.limit = cost, feature, float(limit)
        if self.feature is not None:
            low = rows[:, self.feature] <= self.limit
            self.low, self.high = Tree(rows[low], labels[low], depth - 1), Tree(rows[~low], labels[~low], depth - 1)

    @staticmethod
    def impurity(labels: np.ndarray) -> float:
        p = labels.mean()
        return float(2 * p * (1 - p))

    def decide(self, row: tuple) -> bool:
        node = self
        while node.feature is not None:
            node = node.low if row[node.feature] <= node.limit else node.high
        return node.content


def trained_tree(table=LABELLED) -> Tree:
    rows = np.asarray(table, float)
    return Tree(rows[:, :-1], rows[:, -1])


def _is_apart(name: str, attributes: str) -> bool:
    if name in APART:
        return True
    if not attributes:
        return False
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
        if key in ("class", "id", "role", "aria-label", "itemprop") and name not in ("html", "body", "article", "main") and HINTS.search(value):
            return True
    return False


def blocks(page: str) -> list[tuple[str, int, bool, bool, bool]]:
    """(text, words inside links, apart, main, heading) of every text block, in page order."""
    found: list[tuple[str, int, bool, bool, bool]] = []
    parts: list[str] = []
    linked = 0
    # Open elements: name, silent, apart, main, heading.
    open_: list[tuple[str, bool, bool, bool, bool]] = []
    silent = apart = main = heading = links = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                found.append((text, linked, apart > 0, main > 0, heading > 0))
            parts.clear()
        linked = 0

    def text_of(raw: str) -> None:
        nonlocal linked
        if raw and not silent:
            parts.append(raw)
            if links:
                linked += len(raw.split())

    def close(at: int) -> None:
        nonlocal silent, apart, main, heading
        for _, s, a, m, h in open_[at:]:
            silent, apart, main, heading = silent - s, apart - a, main - m, heading - h
        del open_[at:]

    at, end = 0, len(page)
    while at < end:
        hit = MARKUP.search(page, at)
        if hit is None:
            text_of(page[at:])
            break
        text_of(page[at:hit.start()])
        at = hit.end()
        name = (hit[2] or "").lower()
        if not name:
            continue
        if hit[1]:
            if name == "a":
                links = max(0, links - 1)
            if name in INLINE:
                continue
            flush()
            for i in range(len(open_) - 1, -1, -1):
                if open_[i][0] == name:
                    close(i)
                    break
                # A closing tag does not reach beyond the article or a part of the page.
                if name == "p" or open_[i][0] in ("article", "main", "body") and name not in ("html", "body", "main"):
                    break
            continue
        attributes = hit[3] or ""
        if name == "a":
            links += 1
        if name in INLINE and name != "label":
            continue
        flush()
        if name in VOID or attributes.endswith("/") and name not in RAW:
            continue
        if name == "body":  # ends a head that was left open
            close(0)
        if name in RAW:
            stop = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        if open_ and open_[-1][0] == name and name in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):
            close(len(open_) - 1)
        elif name not in INLINE and open_ and open_[-1][0] == "p":
            close(len(open_) - 1)
        inside_main = main > 0
        # The header of a page is no content, that of an article is.
        away = _is_apart(name, attributes) or name == "header" and not inside_main
        own = (name, name in SILENT, away, name in MAIN or bool(re.search(r"role\s*=\s*[\"']?(?:main|article)\b", attributes)), name in HEADINGS)
        open_.append(own)
        silent, apart, main, heading = silent + own[1], apart + own[2], main + own[3], heading + own[4]
    flush()
    return found


def main_text(page: str | None, tree: Tree) -> str:
    """The content blocks of ``page`` in order, joined by spaces; empty for null or if nothing is content."""
    own = blocks(page or "")
    sizes = [len(b[0].split()) for b in own]
    density = [min(1.0, b[1] / n) for b, n in zip(own, sizes)]
    kept = []
    for i, (text, _, apart, main, heading) in enumerate(own):
        before = (sizes[i - 1], density[i - 1]) if i else (0, 0.0)
        after = (sizes[i + 1], density[i + 1]) if i + 1 < len(own) else (0, 0.0)
        if tree.decide((sizes[i], density[i], *before, *after, apart, main, heading)):
            kept.append(text)
    return " ".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every row of ``pages``; other columns are ignored."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = trained_tree()
        for batch in batches:
            texts = [main_text(page.as_py(), tree) for page in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(
        read, "page_id long, url string, text string")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.char_length("text").cast("long"))
