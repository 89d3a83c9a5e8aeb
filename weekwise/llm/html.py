"""Main text of web pages from flat text blocks.

A page becomes a list of blocks, the runs of text between block-level tags. Every block is described by its word count and
link density and those of its neighbours, and by two marks of the containers around it; a decision tree, grown on a small labelled
table, tells article text from the rest.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import map_slices

# fixed values of the markup language
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style template noscript svg math iframe object applet canvas audio video select datalist textarea button title".split())
UNSEEN = frozenset("script style template noscript".split())
CHROME_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
ARTICLE_TAGS = frozenset("article main".split())
TRACKED = CHROME_TAGS | ARTICLE_TAGS | frozenset("div section header ul ol dl li table figure details body".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
CHROME_WORDS = frozenset(
    "ad ads advert advertisement adverts adbox banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer gdpr "
    "header login masthead menu modal nav navbar navigation newsletter notice notification overlay pager pagination popup promo promoted "
    "promotion recommended related replies respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar topbar widget widgets".split()
)
ARTICLE_WORDS = frozenset("article articlebody content entry post story".split())
# what a container of such things is called after them: comment-list, share-buttons, ad-3
CONTAINER_WORDS = frozenset(
    "area bar block blocks body box button buttons column container content form group head header holder inner item items left link links list main modal "
    "outer panel placeholder post posts right row section slot text title top unit wrap wrapper zone".split()
)
LAYOUT_WORDS = frozenset("has no with without".split())  # has-sidebar tells what stands beside, not what the container is

ATTRIBUTES = r"""(?:[^>"']|"[^"]*"|'[^']*')*+"""
TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(?:[!?]|/(?![A-Za-z]))[^>]*(?:>|\Z)|<(?P<close>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<rest>" + ATTRIBUTES + r")(?:>|\Z)", re.S
)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Block(NamedTuple):
    text: str
    words: int
    linked: int
    article: bool
    chrome: bool


def _around(name: str) -> bool:
    """Whether a class or id names something around an article: it ends in such a word, or begins with one and goes on as containers are called.

    So ``cookie-notice`` and ``comments-list`` do, ``notification-basics`` and ``has-sidebar`` do not.
    """
    parts = [p.lower() for p in PARTS.findall(name)]
    if not parts or LAYOUT_WORDS & set(parts):
        return False
    return parts[-1] in CHROME_WORDS or (parts[0] in CHROME_WORDS and all(p in CHROME_WORDS or p in CONTAINER_WORDS or len(p) == 1 for p in parts))


def _marks(tag: str, rest: str) -> tuple[bool, bool, bool]:
    """Whether a container says that it is an article, that it is something around one by tag, role or being hidden, and the same by class or id."""
    article, chrome, worded = tag in ARTICLE_TAGS, tag in CHROME_TAGS, False
    for name, a, b, c in ATTRIBUTE.findall(rest) if rest else ():
        value, name = a or b or c, name.lower()
        if name == "role":
            chrome |= value.lower() in CHROME_ROLES
            article |= value.lower() in ("main", "article")
        elif name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true"):
            chrome = True
        elif name in ("class", "id") and tag != "body":
            for one in value.split():
                worded |= _around(one)
                article |= bool({p.lower() for p in PARTS.findall(one)} & ARTICLE_WORDS)
    return article, chrome, worded


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order, with words, words inside links and the marks of their containers."""
    found: list[Block] = []
    text: list[tuple[str, bool]] = []
    stack: list[tuple[str, bool, bool, bool]] = []
    opened: set[str] = set()
    at, link, size = 0, False, len(page)

    def flush() -> None:
        if text:
            clean = " ".join(entities.unescape("".join(t for t, _ in text)).split())
            if clean:
                linked = sum(len(entities.unescape(t).split()) for t, inside in text if inside)
                words = len(clean.split(" "))
                found.append(Block(clean, words, min(linked, words), any(s[1] and not (s[2] or s[3]) for s in stack), any(s[2] or s[3] for s in stack)))
            text.clear()

    while at < size:
        begin = page.find("<", at)
        if begin < 0:
            text.append((page[at:], link))
            break
        if begin > at:
            text.append((page[at:begin], link))
        m = TOKEN.match(page, begin)
        if m is None:
            text.append(("&lt;", link))
            at = begin + 1
            continue
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if not m["close"] and tag in RAW:
            if tag not in UNSEEN:
                text.append((" ", link))
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if tag == "a":
            link = not m["close"]
        if tag in INLINE:
            continue
        flush()
        if tag not in TRACKED:
            continue
        if not m["close"]:
            article, chrome, worded = _marks(tag, m["rest"])
            if tag in ARTICLE_TAGS and tag not in opened and opened <= {s[0] for s in stack} and not any(s[2] for s in stack):
                # the first of the page is its text, whatever words it and the containers around it have
                opened.add(tag)
                worded, stack = False, [(*s[:3], False) for s in stack]
            if tag == "header" and not any(s[1] and not (s[2] or s[3]) for s in stack):
                chrome = True  # of the page; the header of an article is part of it
            stack.append((tag, article, chrome, worded))
        elif any(s[0] == tag for s in stack):
            while stack.pop()[0] != tag:
                pass
            link = False
    flush()
    return found


# words, link density, both of the block before, both of the one after, inside an article, inside something around it: is it article text
LABELLED: list[tuple[float, ...]] = [
    (8, 0.0, 0, 0.0, 45, 0.0, 1, 0, 1), (1, 0.0, 60, 0.0, 80, 0.0, 1, 0, 1), (2, 0.0, 0, 0.0, 0, 0.0, 1, 0, 1), (60, 0.0, 8, 0.0, 75, 0.0, 1, 0, 1),
    (120, 0.05, 60, 0.0, 3, 0.0, 1, 0, 1), (35, 0.2, 90, 0.0, 50, 0.1, 1, 0, 1), (12, 0.5, 40, 0.0, 40, 0.0, 1, 0, 1), (5, 1.0, 40, 0.0, 70, 0.0, 1, 0, 1),
    (1, 0.0, 1, 0.0, 1, 0.0, 1, 0, 1), (300, 0.0, 0, 0.0, 0, 0.0, 1, 0, 1), (4, 0.0, 3, 1.0, 50, 0.0, 1, 0, 1), (9, 0.0, 25, 0.0, 2, 1.0, 1, 0, 1),
    (20, 0.0, 12, 1.0, 30, 0.0, 1, 0, 1), (3, 0.0, 20, 0.0, 7, 0.1, 1, 0, 1), (15, 0.0, 2, 1.0, 0, 0.0, 1, 0, 1), (6, 0.0, 0, 0.0, 0, 0.0, 1, 0, 1),
    (3, 0.0, 4, 1.0, 6, 0.0, 1, 0, 1), (1, 0.0, 1, 1.0, 1, 0.0, 1, 0, 1), (2, 0.0, 5, 1.0, 0, 0.0, 1, 0, 1), (4, 0.0, 2, 1.0, 3, 1.0, 1, 0, 1),
    (10, 0.3, 6, 1.0, 8, 1.0, 1, 0, 1), (70, 0.0, 3, 1.0, 2, 1.0, 1, 0, 1), (5, 0.4, 9, 0.0, 0, 0.0, 1, 0, 1), (2, 0.0, 2, 0.0, 4, 1.0, 1, 0, 1),
    (14, 0.0, 8, 0.0, 12, 0.0, 1, 0, 1), (1, 0.0, 7, 0.0, 0, 0.0, 1, 0, 1), (9, 0.0, 1, 0.0, 3, 0.0, 1, 0, 1), (6, 0.2, 4, 0.0, 11, 0.0, 1, 0, 1),
    (3, 1.0, 3, 1.0, 3, 1.0, 1, 0, 1), (5, 1.0, 4, 1.0, 6, 1.0, 1, 0, 1), (2, 1.0, 2, 1.0, 1, 1.0, 1, 0, 1), (7, 1.0, 6, 1.0, 4, 1.0, 1, 0, 1),
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 1, 0), (1, 1.0, 1, 1.0, 1, 1.0, 0, 1, 0), (2, 1.0, 1, 1.0, 14, 0.0, 0, 1, 0), (14, 0.0, 2, 1.0, 8, 0.0, 0, 1, 0),
    (25, 0.0, 1, 1.0, 9, 0.0, 0, 1, 0), (60, 0.0, 40, 0.0, 12, 0.0, 0, 1, 0), (9, 0.2, 50, 0.0, 0, 0.0, 0, 1, 0), (12, 0.0, 70, 0.0, 0, 0.0, 0, 1, 0),
    (30, 0.1, 2, 0.0, 2, 1.0, 0, 1, 0), (90, 0.0, 8, 0.0, 60, 0.0, 0, 1, 0), (6, 1.0, 90, 0.0, 5, 1.0, 1, 1, 0), (40, 0.0, 80, 0.0, 3, 0.0, 1, 1, 0),
    (15, 0.0, 60, 0.0, 22, 0.0, 1, 1, 0), (22, 0.0, 15, 0.0, 18, 0.0, 1, 1, 0), (3, 0.0, 100, 0.0, 40, 0.0, 1, 1, 0), (110, 0.0, 30, 0.0, 5, 0.5, 1, 1, 0),
    (8, 0.0, 2, 1.0, 70, 0.0, 0, 1, 0), (30, 0.0, 1, 1.0, 25, 0.0, 0, 1, 0), (5, 1.0, 4, 1.0, 55, 0.0, 0, 1, 0), (18, 0.0, 0, 0.0, 95, 0.0, 0, 1, 0),
    (45, 0.0, 60, 0.0, 80, 0.0, 1, 1, 0), (12, 0.0, 90, 0.0, 65, 0.0, 1, 1, 0), (4, 0.0, 9, 0.0, 33, 0.0, 0, 1, 0), (28, 0.3, 44, 0.0, 29, 0.0, 1, 1, 0),
    (1, 0.0, 5, 0.0, 5, 0.0, 1, 1, 0), (2, 0.5, 3, 0.0, 0, 0.0, 1, 1, 0),
    (40, 0.0, 8, 0.0, 55, 0.0, 0, 0, 1), (80, 0.05, 40, 0.0, 60, 0.0, 0, 0, 1), (25, 0.0, 60, 0.0, 35, 0.1, 0, 0, 1), (120, 0.0, 2, 1.0, 90, 0.0, 0, 0, 1),
    (8, 0.0, 1, 1.0, 40, 0.0, 0, 0, 1), (6, 0.0, 45, 0.0, 70, 0.0, 0, 0, 1), (18, 0.1, 30, 0.0, 3, 1.0, 0, 0, 1), (35, 0.3, 50, 0.0, 20, 0.0, 0, 0, 1),
    (6, 0.0, 2, 1.0, 60, 0.0, 0, 0, 1), (4, 0.0, 1, 1.0, 90, 0.0, 0, 0, 1), (5, 0.0, 0, 0.0, 70, 0.0, 0, 0, 1), (3, 0.0, 2, 1.0, 35, 0.0, 0, 0, 1),
    (11, 0.0, 70, 0.0, 90, 0.0, 0, 0, 1), (4, 0.0, 60, 0.0, 25, 0.0, 0, 0, 1), (55, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1), (30, 0.0, 0, 0.0, 4, 0.0, 0, 0, 1),
    (1, 1.0, 2, 1.0, 1, 1.0, 0, 0, 0), (3, 1.0, 1, 1.0, 4, 1.0, 0, 0, 0), (2, 1.0, 0, 0.0, 3, 1.0, 0, 0, 0), (5, 0.8, 6, 1.0, 4, 0.7, 0, 0, 0),
    (2, 0.0, 3, 1.0, 2, 1.0, 0, 0, 0), (4, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0), (12, 0.9, 30, 0.0, 5, 1.0, 0, 0, 0), (20, 0.7, 4, 1.0, 9, 1.0, 0, 0, 0),
    (6, 0.0, 2, 1.0, 0, 0.0, 0, 0, 0), (3, 0.0, 1, 1.0, 4, 0.0, 0, 0, 0), (7, 1.0, 50, 0.0, 8, 1.0, 0, 0, 0), (2, 0.0, 4, 0.0, 1, 1.0, 0, 0, 0),
    (4, 0.6, 3, 0.5, 0, 0.0, 0, 0, 0), (9, 1.0, 0, 0.0, 0, 0.0, 0, 0, 0),
]


class Node(NamedTuple):
    """An inner node sends rows with feature <= cut to ``low``; a leaf has the share of article text."""

    share: float
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = 8, least: int = 1) -> Node:
    """A decision tree by the largest drop of Gini impurity; ties go to the first feature and the smallest cut."""
    share = float(labels.mean()) if len(labels) else 0.0
    if depth == 0 or len(labels) < 2 * least or share in (0.0, 1.0):
        return Node(share)
    best = (1e-9, -1, 0.0)
    for f in range(rows.shape[1]):
        order = np.argsort(rows[:, f], kind="stable")
        x, y = rows[order, f], labels[order]
        n, ones = np.arange(1, len(y)), np.cumsum(y)[:-1]
        p, q = ones / n, (y.sum() - ones) / (len(y) - n)
        drop = share * (1 - share) - (n * p * (1 - p) + (len(y) - n) * q * (1 - q)) / len(y)
        drop[(x[1:] == x[:-1]) | (n < least) | (len(y) - n < least)] = 0
        if len(drop) and drop.max() > best[0] + 1e-12:
            k = int(drop.argmax())
            best = (float(drop[k]), f, float(x[k] + x[k + 1]) / 2)
    if best[1] < 0:
        return Node(share)
    low = rows[:, best[1]] <= best[2]
    return Node(share, best[1], best[2], grow(rows[low], labels[low], depth - 1, least), grow(rows[~low], labels[~low], depth - 1, least))


def is_article(tree: Node, row: Sequence[float]) -> bool:
    while tree.feature >= 0:
        tree = tree.low if row[tree.feature] <= tree.cut else tree.high
    return tree.share >= 0.5


def features(found: list[Block]) -> list[tuple[float, ...]]:
    """One row per block: words and link density of it, of the one before and of the one after, and the two marks."""
    own = [(float(b.words), b.linked / b.words) for b in found]
    padded = [(0.0, 0.0), *own, (0.0, 0.0)]
    return [(*own[i], *padded[i], *padded[i + 2], float(b.article), float(b.chrome)) for i, b in enumerate(found)]


def main_text(page: str | None, tree: Node) -> str:
    found = blocks(page or "")
    return "\n".join(b.text for b, row in zip(found, features(found), strict=True) if is_article(tree, row))


def extract(
    pages: DataFrame, labelled: Sequence[Sequence[float]] = LABELLED, page_id: str = "page_id", url: str = "url", html: str = "html",
) -> DataFrame:
    """(page_id, url, text, n_chars) for every row; NULL and empty pages have an empty text. Repeated rows stay.

    The tree is grown on ``labelled`` (a small table, the label last). Each page is read where it lies, without a shuffle.
    """
    table = np.array(labelled, float)
    tree = grow(table[:, :-1], table[:, -1])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(x, tree) for x in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )

    rows = pages.select(pages[page_id].cast("bigint").alias("page_id"), pages[url].cast("string").alias("url"), pages[html].cast("string").alias("html"))
    return map_slices(rows, run, "page_id BIGINT, url STRING, text STRING, n_chars BIGINT", text=2)
