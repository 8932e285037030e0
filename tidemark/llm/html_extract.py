"""Main text of web pages: gradient-boosted trees over the features of DOM elements, hierarchical decoding.

The trees say for each element whether main text lies in it. Decoding keeps the elements with the best sum
of log odds under the rule that an element is only kept with all its ancestors, so no decision contradicts
another. There are no labelled pages, so the trees are fitted on sample pages made from a seed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import text_slices
from tidemark.llm.dom import Page
from tidemark.llm.page_samples import sample_pages

PAGES, SEED = 500, 11  # sample pages that the trees are fitted on
TREES, DEPTH = 24, 5


@dataclass
class Trees:
    """Boosted trees as arrays: of each node its feature (-1: a leaf), threshold, children and value."""

    roots: list[int]
    weights: list[float]
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for root, weight in zip(self.roots, self.weights, strict=True):
            at = np.full(len(x), root)
            for _ in range(DEPTH + 1):
                f = self.feature[at]
                on = f >= 0
                if not on.any():
                    break
                down = np.where(x[np.arange(len(x)), np.maximum(f, 0)] <= self.threshold[at], self.left[at], self.right[at])
                at = np.where(on, down, at)
            total += weight * self.value[at]
        return 2 * total


def _unfold(model) -> Trees:
    rows: list[list] = []

    def add(node) -> int:
        k = len(rows)
        rows.append([-1, 0.0, 0, 0, float(node.prediction())])
        if node.getClass().getSimpleName() == "InternalNode":
            split = node.split()
            rows[k][:2] = split.featureIndex(), float(split.threshold())
            rows[k][2], rows[k][3] = add(node.leftChild()), add(node.rightChild())
        return k

    roots = [add(t._java_obj.rootNode()) for t in model.trees]
    f, t, left, right, v = zip(*rows, strict=True)
    return Trees(roots, list(model.treeWeights), np.array(f), np.array(t), np.array(left), np.array(right), np.array(v))


_FITTED: dict = {}


def fit_trees(spark: SparkSession, pages: int = PAGES, seed: int = SEED) -> Trees:
    """Fitted once a session; the sample doesn't depend on any input."""
    key = (spark.sparkContext.applicationId, pages, seed)
    if key not in _FITTED:
        found = [Page(html) for html in sample_pages(pages, seed)]
        x, y = np.concatenate([p.features()[1:] for p in found]), np.concatenate([p.labels()[1:] for p in found])
        seen = ~np.concatenate([np.array(p.hidden[1:]) for p in found])
        x, y = x[seen], y[seen]
        table = pa.table({"x": pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.astype(np.float64).ravel())), "label": pa.array(y.astype(np.float64))})
        rows = spark.createDataFrame(table).repartition(4).select(array_to_vector("x").alias("features"), "label").cache()
        model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=32, stepSize=0.3, seed=seed, minInstancesPerNode=5).fit(rows)
        rows.unpersist()
        _FITTED[key] = _unfold(model)
    return _FITTED[key]


def extract_texts(trees: Trees, pages: list[str | None]) -> list[str]:
    """Main texts; elements of a run of pages go through the trees together."""
    found = [Page(html or "") for html in pages]
    x = [p.features() for p in found]
    odds = trees.log_odds(np.concatenate(x)) if x else np.zeros(0)
    ends = np.cumsum([0, *map(len, x)])
    return [p.text(p.decode(odds[a:z])) for p, a, z in zip(found, ends[:-1], ends[1:], strict=True)]


def _extract(trees, html_at: int):
    def run(batches):
        for b in batches:
            for a, z in text_slices(b.column(html_at), 500_000):
                part = b.slice(a, z - a)
                texts = extract_texts(trees.value, part.column(html_at).to_pylist())
                yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(part.columns) if i != html_at), pa.array(texts, pa.string())], names=[*(n for i, n in enumerate(part.schema.names) if i != html_at), "text"])
    return run


def extract_main_text(pages: DataFrame, trees: Trees | None = None) -> DataFrame:
    """``page_id, url, text`` of each row of ``pages``.

    A null or empty html, or one without main text, gives an empty text. Whole pages are read. Repeated rows
    and null ids and urls stay as they are; other columns are ignored; an empty table gives no rows.
    """
    spark = pages.sparkSession
    trees = spark.sparkContext.broadcast(trees or fit_trees(spark))
    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    return pages.select("page_id", "url", "html").mapInArrow(_extract(trees, 2), f"{kinds}, text string")


def op1_html_text(spark, sf_dir: str) -> DataFrame:
    """Each page's main text and its length."""
    text = extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return text.withColumn("n_chars", F.char_length("text").cast("long"))
