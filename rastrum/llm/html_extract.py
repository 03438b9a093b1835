"""Main-text extraction from HTML by shallow text features.

A page is flattened to text blocks: runs of text between block-level tags,
without scripts, styles, comments and titles.  A block is described by the
number of its words and its link density (share of words inside links), and by
those of the blocks before and after it (Kohlschuetter et al. 2010).  A
decision tree trained on a small labelled table, the block sequences of a few
page layouts, tells content from boilerplate.

Defined results: null and empty pages, and pages without text, give an empty
text and 0 blocks; unclosed comments, scripts and tags reach to the end of the
page; text is whole, however long; a page is decided by itself, so that
repeated rows give repeated results; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import column

DEPTH = 7
LEAST_LEAF = 2

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|title|svg)\b.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)[^>]*(?:>|\Z)", re.S | re.I)
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead tr ul".split()
)

#: The labelled table: for each example page its blocks as (words, link density, whether content).
LABELLED: list[list[tuple[int, float, int]]] = [
    [*[(1, 1.0, 0)] * 6, (8, 0.0, 0), (11, 0.0, 1), (150, 0.0, 1), (90, 0.0, 1), (24, 0.0, 1), (2, 0.0, 1), (60, 0.0, 1), (9, 0.0, 0)],
    [*[(1, 1.0, 0)] * 5, (5, 0.0, 0), (7, 0.0, 1), (40, 0.0, 1), (1, 0.0, 1), (130, 0.01, 1), (2, 0.0, 1), (14, 0.0, 0)],
    [*[(1, 1.0, 0)] * 7, (11, 0.0, 0), (3, 0.0, 1), (12, 0.0, 1), (8, 0.0, 0)],
    [*[(2, 1.0, 0)] * 8, (6, 0.0, 0), (12, 0.0, 1), (80, 0.0, 1), (75, 0.03, 1), (5, 0.0, 1), (1, 0.0, 1), (3, 0.0, 1), (33, 0.0, 1), (10, 0.0, 0)],
    [*[(1, 1.0, 0)] * 6, (9, 0.0, 0), (10, 0.0, 1), (1, 0.0, 1), (7, 0.0, 0)],
    [*[(1, 1.0, 0)] * 6, (10, 0.0, 0), (1, 0.0, 1), (3, 0.0, 1), (6, 0.0, 1), (3, 0.0, 1), (12, 0.0, 0)],
    [*[(1, 1.0, 0)] * 4, (14, 0.0, 0), (9, 0.0, 1), (9, 0.0, 1), (9, 0.0, 1), (20, 0.0, 1), (12, 0.0, 1), (9, 0.0, 0)],
    [*[(3, 1.0, 0)] * 5, (2, 0.5, 0), (9, 0.0, 1), (200, 0.02, 1), (95, 0.05, 1), (110, 0.0, 1), (4, 1.0, 0), (3, 1.0, 0), (6, 0.6, 0)],
    [(4, 0.75, 0), (2, 1.0, 0), (2, 1.0, 0), (12, 0.0, 1), (45, 0.1, 1), (66, 0.0, 1), (28, 0.0, 1), (5, 0.8, 0), (6, 0.9, 0), (4, 1.0, 0), (11, 0.3, 0)],
    [*[(1, 1.0, 0)] * 9, (7, 0.0, 0), (8, 0.0, 1), (300, 0.0, 1), (4, 0.0, 1), (260, 0.0, 1), (8, 0.0, 0)],
    [*[(1, 1.0, 0)] * 6, (8, 0.0, 0), (11, 0.0, 1), (2, 0.0, 1), (2, 0.0, 1), (1, 0.0, 1), (70, 0.0, 1), (1, 0.0, 1), (14, 0.0, 0)],
    [*[(2, 1.0, 0)] * 3, (20, 0.0, 1), (35, 0.2, 1), (18, 0.0, 1), (3, 1.0, 0), (3, 1.0, 0), (2, 1.0, 0)],
]


def features(blocks: list[tuple[int, float]]) -> np.ndarray:
    """[block, (words and density before, own, after)]; zeros beyond the ends."""
    x = np.zeros((len(blocks) + 2, 2))
    if blocks:
        x[1:-1] = [(b[0], b[1]) for b in blocks]
    return np.concatenate([x[:-2], x[1:-1], x[2:]], axis=1)


@dataclass
class Tree:
    """A binary decision tree in arrays; a leaf has feature -1."""

    feature: list[int]
    at: list[float]
    left: list[int]
    right: list[int]
    value: list[int]

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.int64)
        f, at, left, right = (np.array(v) for v in (self.feature, self.at, self.left, self.right))
        while (f[node] >= 0).any():
            inner = f[node] >= 0
            n = node[inner]
            node[inner] = np.where(x[inner, f[n]] <= at[n], left[n], right[n])
        return np.array(self.value)[node]


def fit(x: np.ndarray, y: np.ndarray, depth: int = DEPTH, least: int = LEAST_LEAF) -> Tree:
    """CART by Gini impurity; of equal splits the first feature and the least threshold."""
    tree = Tree([], [], [], [], [])

    def grow(rows: np.ndarray, deep: int) -> int:
        me = len(tree.feature)
        for field, v in zip((tree.feature, tree.at, tree.left, tree.right, tree.value), (-1, 0.0, -1, -1, int(y[rows].mean() >= 0.5)), strict=True):
            field.append(v)
        best = None
        if deep < depth and len(rows) >= 2 * least and len(set(y[rows])) > 1:
            p = y[rows].mean()
            parent = len(rows) * p * (1 - p)
            for f in range(x.shape[1]):
                order = rows[np.argsort(x[rows, f], kind="stable")]
                v, t = x[order, f], np.cumsum(y[order])
                for k in range(least, len(order) - least + 1):
                    if v[k - 1] < v[k] if k < len(order) else False:
                        a, b = t[k - 1] / k, (t[-1] - t[k - 1]) / (len(order) - k)
                        gain = parent - k * a * (1 - a) - (len(order) - k) * b * (1 - b)
                        if best is None or gain > best[0] + 1e-12:
                            best = (gain, f, (v[k - 1] + v[k]) / 2)
        if best is not None and best[0] > 1e-12:
            _, f, at = best
            below = x[rows, f] <= at
            tree.feature[me], tree.at[me] = f, at
            tree.left[me] = grow(rows[below], deep + 1)
            tree.right[me] = grow(rows[~below], deep + 1)
        return me

    grow(np.arange(len(x)), 0)
    return tree


def train(pages: list[list[tuple[int, float, int]]] | None = None) -> Tree:
    pages = LABELLED if pages is None else pages
    x = np.concatenate([features([(w, d) for w, d, _ in p]) for p in pages])
    return fit(x, np.array([c for p in pages for *_, c in p]))


def blocks(page: str) -> list[tuple[int, float, str]]:
    """(words, link density, text) of the text blocks of a page, in order."""
    out: list[tuple[int, float, str]] = []
    parts: list[str] = []
    linked = at = inside = 0

    def text(s: str) -> None:
        nonlocal linked
        if s and not s.isspace():
            s = html.unescape(s)
            if inside:
                linked += len(s.split())
            parts.append(s)
        elif s:
            parts.append(" ")

    def close() -> None:
        nonlocal linked
        words = "".join(parts).split()
        if words:
            out.append((len(words), min(1.0, linked / len(words)), " ".join(words)))
        parts.clear()
        linked = 0

    for m in _TOKEN.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        name = m.group(3)
        if name is None:
            continue
        name = name.lower()
        if name == "a":
            inside = 0 if m.group(2) else 1
        elif name in _BLOCKS:
            close()
        elif name == "br":
            parts.append(" ")
    text(page[at:])
    close()
    return out


RESULT = "page_id long, text string, n_words long, n_content long, n_blocks long"


def extract(pages: DataFrame, tree: Tree | None = None, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """The content blocks of each page, one a line."""
    model = train() if tree is None else tree

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [blocks(p or "") for p in column(b, "html").to_pylist()]
            if not found:
                continue
            x = [features([(w, d) for w, d, _ in p]) for p in found]
            keep = model.predict(np.concatenate(x)).astype(bool)
            rows, k = [], 0
            for p in found:
                own = [q for q, ok in zip(p, keep[k : k + len(p)], strict=True) if ok]
                k += len(p)
                rows.append(("\n".join(q[2] for q in own), sum(q[0] for q in own), len(own), len(p)))
            yield pa.RecordBatch.from_arrays([column(b, "page_id"), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64())))], names=["page_id", "text", "n_words", "n_content", "n_blocks"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("html")).mapInArrow(run, RESULT)
