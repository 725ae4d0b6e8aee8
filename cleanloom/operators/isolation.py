"""Isolation forest (Liu, Ting and Zhou, 2008) on Spark.

Trees need only small subsamples, so fitting reads a bounded hash sample of the table and builds one
tree per group. The forest has a fixed maximum size, whatever the table's, and travels with the
scoring function, which is Arrow-vectorised.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cleanloom.functions.columns import ref

TREES = 100
SUBSAMPLE = 256
POOL_SUBSAMPLES = 40  # rows the trees draw from, in subsamples
SCORE_ROWS = 2048  # rows scored together: the working set stays in cache
EULER = 0.5772156649015329


@dataclass(frozen=True)
class Forest:
    features: tuple[str, ...]
    subsample: int
    # Per tree: node arrays (feature, threshold, left, right, path length at a leaf).
    trees: tuple[tuple[np.ndarray, ...], ...]


def average_path(n) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary tree of n points."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3)
    long = 2.0 * (np.log(safe - 1.0) + EULER) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, long))


def grow(points: np.ndarray, rng: np.random.Generator, max_depth: int) -> list[tuple]:
    """Nodes (feature, threshold, left, right, path) of one random tree; feature -1 marks a leaf."""
    nodes: list[tuple] = []
    waiting = [(np.arange(len(points)), 0, None, None)]
    while waiting:
        rows, depth, parent, side = waiting.pop()
        place = len(nodes)
        if parent is not None:
            entry = list(nodes[parent])
            entry[2 + side] = place
            nodes[parent] = tuple(entry)
        low, high = points[rows].min(axis=0), points[rows].max(axis=0)
        splittable = np.flatnonzero(high > low)
        if depth >= max_depth or len(rows) <= 1 or not len(splittable):
            nodes.append((-1, 0.0, -1, -1, depth + float(average_path(len(rows)))))
            continue
        feature = int(rng.choice(splittable))
        threshold = float(rng.uniform(low[feature], high[feature]))
        left = points[rows, feature] <= threshold
        if left.all():  # rounding put the cut on the maximum
            left = points[rows, feature] < high[feature]
        nodes.append((feature, threshold, -1, -1, 0.0))
        waiting += [(rows[left], depth + 1, place, 0), (rows[~left], depth + 1, place, 1)]
    return nodes


def fit_forest(features: DataFrame, names: list[str], key: list[str], rows: int, seed: int = 42,
               trees: int = TREES, subsample: int = SUBSAMPLE) -> Forest:
    """Fit on complete feature columns. ``key`` is unique per row, so that copies are sampled independently."""
    size = min(subsample, rows)
    pool = POOL_SUBSAMPLES * size
    keys = [ref(k) for k in key]
    columns = [ref(n).alias(f"x{i}") for i, n in enumerate(names)]
    draw = F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 30)).alias("h")
    drawn = features.select(draw, F.xxhash64(*keys).alias("r"), *columns)
    # One rule for all sizes: a hash sample of at most about ``pool`` rows is the pool, and each tree draws its own subsample from it.
    sampled = drawn.filter(F.col("h") <= F.lit(min(1 << 30, int(pool / max(rows, 1) * (1 << 30))))).withColumn(
        "tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    order = Window.partitionBy("tree").orderBy(F.xxhash64("r", "tree"), "r")
    chosen = sampled.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= size)
    max_depth = int(np.ceil(np.log2(max(size, 2))))
    width = len(names)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        points = pdf.sort_values("place")[[f"x{i}" for i in range(width)]].to_numpy(dtype=float)
        nodes = grow(points, np.random.default_rng((seed, tree)), max_depth)
        frame = pd.DataFrame(nodes, columns=["feature", "threshold", "left", "right", "path"])
        frame.insert(0, "node", np.arange(len(nodes)))
        frame.insert(0, "tree", tree)
        return frame

    built = chosen.groupBy("tree").applyInPandas(
        build, "tree int, node int, feature int, threshold double, left int, right int, path double")
    table = built.toPandas().sort_values(["tree", "node"])  # at most trees x (2 x subsample - 1) rows
    forest = tuple(
        tuple(part[c].to_numpy() for c in ("feature", "threshold", "left", "right", "path"))
        for _, part in table.groupby("tree"))
    return Forest(tuple(names), size, forest)


def _flat(forest: Forest) -> tuple[np.ndarray, ...]:
    """All trees in one set of node arrays; a leaf leads to itself, so every walk has the same length."""
    sizes = [len(tree[0]) for tree in forest.trees]
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    feature = np.concatenate([np.maximum(t[0], 0) for t in forest.trees])
    threshold = np.concatenate([t[1] for t in forest.trees])
    path = np.concatenate([t[4] for t in forest.trees])
    child = np.empty((sum(sizes), 2), dtype=np.int64)
    for start, (split, _, left, right, _) in zip(starts, forest.trees):
        own = np.arange(len(split))
        child[start:start + len(split), 0] = start + np.where(split < 0, own, left)
        child[start:start + len(split), 1] = start + np.where(split < 0, own, right)
    return starts, feature, threshold, child.ravel(), path


def score_points(forest: Forest, points: np.ndarray) -> np.ndarray:
    """Negated anomaly scores in [-1, 0): lower is more abnormal."""
    starts, feature, threshold, child, path = _flat(forest)
    depth = int(np.ceil(np.log2(max(forest.subsample, 2))))
    scale = float(average_path(forest.subsample)) or 1.0
    width = points.shape[1]
    total = np.empty(len(points))
    for low in range(0, len(points), SCORE_ROWS):
        part = np.ascontiguousarray(points[low:low + SCORE_ROWS])
        values, base = part.ravel(), (np.arange(len(part)) * width)[:, None]
        at = np.broadcast_to(starts, (len(part), len(starts)))
        for _ in range(depth):
            beyond = values.take(base + feature.take(at)) > threshold.take(at)
            at = child.take(2 * at + beyond)
        total[low:low + SCORE_ROWS] = path.take(at).sum(axis=1)
    return -np.power(2.0, -total / len(starts) / scale)


def score_column(forest: Forest, columns: list[Column]) -> Column:
    @F.pandas_udf("double")
    def score(features: pd.DataFrame) -> pd.Series:
        return pd.Series(score_points(forest, features.to_numpy(dtype=float)))

    return score(F.struct(*[c.cast("double").alias(f"x{i}") for i, c in enumerate(columns)]))
