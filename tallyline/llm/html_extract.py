"""Main text of web pages: gradient-boosted trees over DOM-node features, decoded along the hierarchy.

The trees are fitted with Spark ML on the nodes of LAYOUTS generated layouts with known main text, filled with texts of
a bounded sample of the pages themselves. Every node of every page gets a probability of being kept; the decoding then
picks the most likely set of nodes in which no kept node stands below a dropped one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, carried, cut_lineage, hash_sample, kind_of, text_of
from .dom import FEATURES, features, parse, text_of_kept
from .html_layouts import layout

#: Generated pages that the trees are fitted on.
LAYOUTS = 1600
#: Pages whose texts fill the layouts, at most: those with the smallest hash of their id.
SAMPLE_PAGES = 64
#: Texts taken from each of them, and characters of a text, at most: the layouts' filling only.
SAMPLE_TEXTS, SAMPLE_CHARS = 12, 1500
TREES, DEPTH, STEP, SEED = 20, 6, 0.3, 11
#: Nodes scored at once.
NODES = 1 << 15
OWN = FEATURES.index("log_own_text")


@dataclass
class Forest:
    """Regression trees as flat arrays, a row for each tree; their weighted sum is half the log-odds."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    weights: np.ndarray

    @staticmethod
    def of(model: GBTClassificationModel) -> Forest:
        trees = [_nodes(tree.toDebugString) for tree in model.trees]
        width = max(map(len, trees))
        columns = [np.array([[node[k] for node in tree] + [0] * (width - len(tree)) for tree in trees], dtype=t) for k, t in enumerate((np.int64, np.float64, np.int64, np.int64, np.float64))]
        return Forest(*columns, np.array(model.treeWeights))

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        margin, rows = np.zeros(len(x)), np.arange(len(x))
        for t, weight in enumerate(self.weights):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):  # a leaf leads to itself
                goes_left = x[rows, self.feature[t][at]] <= self.threshold[t][at]
                at = np.where(goes_left, self.left[t][at], self.right[t][at])
            margin += weight * self.value[t][at]
        return 1 / (1 + np.exp(-2 * margin))


def _nodes(text: str) -> list[tuple]:
    """(feature, threshold, left, right, value) by node, from Spark's description of a tree."""
    lines = [line.strip() for line in text.splitlines()[1:] if line.strip()]
    nodes: list[tuple] = []

    def read(k: int) -> tuple[int, int]:
        at = len(nodes)
        nodes.append(())
        if leaf := re.fullmatch(r"Predict: (\S+)", lines[k]):
            nodes[at] = (0, np.inf, at, at, float(leaf[1]))
            return at, k + 1
        m = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", lines[k])
        left, k = read(k + 1)
        right, k = read(k + 1)  # the line at k is the Else
        nodes[at] = (int(m[1]), float(m[2]), left, right, 0.0)
        return at, k

    read(0)
    return nodes


def fit_extractor(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> Forest:
    """Fits the trees; an empty table is filled with a fixed sentence instead."""

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for html in batch["html"]:
                page = parse(html)
                by_node: dict[int, str] = {}
                for node, text in page.pieces:
                    if node >= 0 and page.tags[node] in ("p", "b", "div", "li", "td", "span"):
                        by_node[node] = by_node.get(node, "") + text
                found += sorted((" ".join(t.split())[:SAMPLE_CHARS] for t in by_node.values() if t.strip()), key=len)[-SAMPLE_TEXTS:]
            yield pd.DataFrame({"text": found}, dtype=object)

    sample = hash_sample(pages.select(F.col(id_col).alias("page"), text_of(html_col).alias("html")), "page", pages.count(), SAMPLE_PAGES)
    filling = sorted(r["text"] for r in sample.mapInPandas(texts, "text string").collect()) or ["No page of the table holds a text."]

    def nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for seed in batch["id"]:
                html, labels = layout(int(seed), filling)
                x = features(parse(html))
                if len(x) != len(labels):
                    raise ValueError(f"layout {seed} is read as {len(x)} elements, not {len(labels)}")
                yield pd.DataFrame({"x": list(x), "label": np.array(labels, dtype=float)})

    rows = pages.sparkSession.range(0, LAYOUTS, 1, 4).mapInPandas(nodes, "x array<double>, label double")
    train = cut_lineage(rows.select(array_to_vector("x").alias("features"), "label"))
    return Forest.of(GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, subsamplingRate=0.8, maxBins=32, minInstancesPerNode=5, seed=SEED).fit(train))


def decode(parents: list[int], probabilities: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The most likely nodes to keep, such that a kept node's ancestors are kept."""
    p = np.clip(probabilities, 1e-6, 1 - 1e-6)
    keep, drop = np.log(p) * weights, np.log(1 - p) * weights
    for i in range(len(parents) - 1, -1, -1):
        if (up := parents[i]) >= 0:
            keep[up] += max(keep[i], drop[i])
            drop[up] += drop[i]
    kept = np.zeros(len(parents), dtype=bool)
    for i, up in enumerate(parents):
        kept[i] = (up < 0 or kept[up]) and keep[i] >= drop[i]
    return kept


def main_texts(htmls: list[str], forest: Forest) -> list[str]:
    """The main text of each page."""
    out: list[str] = []
    held, size = [], 0

    def done() -> None:
        rows = [features(page) for page in held]
        scores = forest.probabilities(np.concatenate(rows)) if rows else np.zeros(0)
        at = 0
        for page, x in zip(held, rows, strict=True):
            p, at = scores[at : at + len(x)], at + len(x)
            kept = decode(page.parents, p, 1 + np.sqrt(np.expm1(x[:, OWN])))
            out.append(text_of_kept(page, kept))

    for html in htmls:
        page = parse(html)
        if not page.tags:  # nothing but white space
            page.tags, page.parents, page.attributes = ["body"], [-1], [""]
        held.append(page)
        size += len(page.tags)
        if size >= NODES:
            done()
            held, size = [], 0
    done()
    return out


def extract_text(pages: DataFrame, forest: Forest, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: id, url, text, n_chars (code points of text).

    Null or empty html gives an empty text and 0; html is read whole. Text without
    any tag stands in an implied body. Null ids and
    urls and repeated rows each keep their row; other columns are ignored, whatever their names; an empty table gives
    an empty result. Broken markup never fails: unknown tags are elements, missing end tags are implied.
    """
    bound_batches(pages)
    rows = pages.select(carried(id_col).alias("page"), F.col(url_col).alias("address"), text_of(html_col).alias("html"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.iloc[k : k + 256].copy()
                part["text"] = main_texts(part.pop("html").tolist(), forest)
                yield part

    found = rows.mapInPandas(run, "page string, address string, text string")
    return found.select(F.col("page").cast(kind_of(pages, id_col)).alias(id_col), F.col("address").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
