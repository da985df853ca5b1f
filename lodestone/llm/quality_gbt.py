"""Quality classifier: histogram gradient-boosted trees over document statistics.

Fitted by numpy on at most FIT_ROWS labelled documents (a documented bound; ids in hash order,
those with crc32 mod 4 = 2 held out), then flattened into arrays of complete binary trees and
applied to every text in Arrow batches, all trees of a batch at once. Inputs are statistics of the
text alone.

Cases: null, empty and blank texts have all statistics zero and get a score like any other; without
labelled rows, or with one class, the score is the smoothed share of that class; repeated rows score alike; extra columns are
ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import id_remainder
from lodestone.llm.statistics import FEATURES, features, labelled_sample, per_row

FIT_ROWS = 20_000
TREES, DEPTH, BINS, RATE, RIDGE = 60, 4, 64, 0.15, 5.0
THRESHOLD = 0.7


def fit(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Trees as arrays: feature and cut by (tree, inner node), value by (tree, leaf), and base."""
    p = (y.sum() + 1) / (len(y) + 2)
    model = {"feature": np.zeros((TREES, 2**DEPTH - 1), np.int64), "cut": np.full((TREES, 2**DEPTH - 1), np.inf), "value": np.zeros((TREES, 2**DEPTH)), "base": np.array(np.log(p / (1 - p)))}
    if len(np.unique(y)) < 2:
        return model
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])
    n, width = x.shape
    margin = np.full(n, float(model["base"]))
    columns = np.arange(width) * BINS
    for t in range(TREES):
        prob = 1 / (1 + np.exp(-margin))
        g, h = prob - y, prob * (1 - prob)
        node = np.zeros(n, np.int64)
        for d in range(DEPTH):
            slot = ((node[:, None] * width * BINS) + columns + binned).ravel()
            shape = (2**d, width, BINS)
            size = 2**d * width * BINS
            gs = np.bincount(slot, np.repeat(g, width), size).reshape(shape).cumsum(2)
            hs = np.bincount(slot, np.repeat(h, width), size).reshape(shape).cumsum(2)
            gt, ht = gs[..., -1:], hs[..., -1:]
            gain = gs**2 / (hs + RIDGE) + (gt - gs) ** 2 / (ht - hs + RIDGE) - gt**2 / (ht + RIDGE)
            gain[(hs < 1) | (ht - hs < 1)] = 0
            best = gain.reshape(2**d, -1).argmax(1)
            for k in range(2**d):
                j, b = divmod(int(best[k]), BINS)
                if gain[k, j, b] > 1e-6 and b < len(edges[j]):
                    model["feature"][t, 2**d - 1 + k], model["cut"][t, 2**d - 1 + k] = j, edges[j][b]
            f, c = model["feature"][t, 2**d - 1 + node], model["cut"][t, 2**d - 1 + node]
            node = 2 * node + (x[np.arange(n), f] > c)
        gs, hs = np.bincount(node, g, 2**DEPTH), np.bincount(node, h, 2**DEPTH)
        model["value"][t] = -RATE * gs / (hs + RIDGE)
        margin += model["value"][t, node]
    return model


def predict(model: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Probability of label 1; all trees are walked together, level by level."""
    trees = np.arange(TREES)
    node = np.zeros((len(x), TREES), np.int64)
    for d in range(DEPTH):
        at = 2**d - 1 + node
        node = 2 * node + (x[np.arange(len(x))[:, None], model["feature"][trees, at]] > model["cut"][trees, at])
    return 1 / (1 + np.exp(-(model["base"] + model["value"][trees, node].sum(1))))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = FIT_ROWS) -> dict[str, np.ndarray]:
    sample = labelled_sample(docs, labels, label, rows).withColumn("h", F.xxhash64("text"))
    got = per_row(sample, lambda data, offsets: [features(data, offsets)], "x array<double>", ("doc_id", "h", "y"))
    got = got.groupBy("doc_id").agg(F.min(F.struct("h", "x", "y")).alias("s")).select("s.x", "s.y", "doc_id").toPandas().sort_values("doc_id")
    x = np.array(got["x"].tolist(), float).reshape(len(got), len(FEATURES))
    return fit(x, got["y"].to_numpy(float))


def score(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = per_row(docs, lambda data, offsets: [predict(shared.value, features(data, offsets))], "score double")
    return scored.select("doc_id", (id_remainder(F.col("doc_id")) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
