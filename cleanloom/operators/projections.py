"""Approximate k-nearest-neighbour join by random projections, with exact distances.

In each of ``tables`` tables points are sorted by a key: on which side of the median they lie along some random directions, one bit a direction, and
then their place along a further one. Near points get equal bits and near places more often than far ones. The sorted table is dealt by
ranges, cut into leaves of ``leaf`` points, and every point meets its own leaf and the two beside it, with exact distances. The best of all tables are kept.

Tables are searched in rounds: the k best so far are written, and what the round shuffled is dropped before the next. So disk holds the
points ``ROUND`` times at most, not once for each table (small tables, of ``ROUND_VALUES`` coordinates a round, need fewer rounds).

So a point meets at most ``3 * tables * leaf`` others whatever the table's size, and the join is linear in the points; the exact way
(:mod:`cleanloom.operators.neighbours`) is quadratic where distances prune little. Ranges split any crowd of points; equal vectors are one point with a
weight. Neighbours may be missed, but a distance is never wrong. Medians are taken of a bounded sample (``SAMPLE`` points, by hash).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cleanloom.operators.neighbours import MAX_TASKS, _Chunk, _matrix
from cleanloom.session import drop_scratch, release, scratch_path

TABLES = 40
ROUND = 8
ROUND_VALUES = 16_000_000  # 128 MB of coordinates
LEAF = 256
SAMPLE = 4096
MAX_BITS = 40
TASK_LEAVES = 8
KEYED = "pid long, x array<double>, w long, asks boolean, found boolean, t int, key long, at double"
ANSWERS = "pid long, nid long, nw long, distance double"


@dataclass(frozen=True)
class ProjectedIndex:
    """Points on shared storage, and what travels to tasks: directions and medians, a fixed number of each."""

    path: str
    directions: np.ndarray  # (tables, bits + 1, width)
    middles: np.ndarray  # (tables, bits)
    points: int
    leaf: int


def build_projections(points: DataFrame, path: str, seed: int = 42, tables: int = TABLES, leaf: int = LEAF) -> ProjectedIndex:
    """Index the distinct vectors (pid, x, w) that lie under ``path``."""
    facts = points.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d")).first()
    n, width = facts["n"], max(facts["d"] or 1, 1)
    bits = min(MAX_BITS, max(0, math.floor(math.log2(max(n / leaf, 1)))))
    directions = np.random.default_rng(seed).normal(size=(tables, bits + 1, width))
    if not bits:
        return ProjectedIndex(path, directions, np.zeros((tables, 0)), n, leaf)
    draw = F.pmod(F.xxhash64("pid", F.lit(seed)), F.lit(1 << 30))
    share = min(1.0, (2.0 * SAMPLE + 64) / n)
    sample = (points.select("x", "pid", draw.alias("h")).filter(F.col("h") < F.lit(int(share * (1 << 30)) + 1))
              .orderBy("h", "pid").limit(SAMPLE).select("x").toPandas())
    along = np.einsum("nd,tbd->tbn", _matrix(sample["x"]), directions[:, :-1])
    return ProjectedIndex(path, directions, np.median(along, axis=2), n, leaf)


def _keyed(index: ProjectedIndex, tables: range):
    """A row per point and table, with its key and its place along the last direction."""
    bits = index.middles.shape[1]
    value = (1 << np.arange(bits, dtype=np.int64))[::-1]

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch["x"])
            for t in tables:
                along = x @ index.directions[t].T
                yield batch.assign(t=np.int32(t), key=((along[:, :-1] > index.middles[t]) * value).sum(axis=1).astype(np.int64), at=along[:, -1])

    return run


class _Leaf:
    """Points of a leaf: those that ask, and those that may be found."""

    def __init__(self, rows: pd.DataFrame):
        self.pid, self.x, self.w = rows["pid"].to_numpy(), _matrix(rows["x"]), rows["w"].to_numpy()
        self.asks, self.found = rows["asks"].to_numpy(), rows["found"].to_numpy()


def _answers(leaf: _Leaf, around: list[_Leaf], k: int, exclude_self: bool) -> pd.DataFrame:
    pid, x, w = (np.concatenate([getattr(o, c)[o.found] for o in around]) for c in ("pid", "x", "w"))
    order = np.argsort(pid)  # as blocks of the exact search
    chunk = _Chunk(leaf.pid[leaf.asks], leaf.x[leaf.asks], k, exclude_self, np.inf, np.zeros(0))
    chunk.meet(pid[order], w[order], x[order], np.zeros(len(pid)))
    return pd.concat(batch.to_pandas() for batch in chunk.result()).drop(columns="place")


def _leaves(index: ProjectedIndex, k: int, exclude_self: bool):
    def run(batches):
        """Rows come in order of table and key; a leaf waits for the one behind it."""
        held, before, current, table = [], None, None, None

        def close(after):
            if current is not None and current.asks.any():
                yield _answers(current, [leaf for leaf in (before, current, after) if leaf is not None], k, exclude_self)

        for batch in batches:
            held.append(batch)
            rows = pd.concat(held, ignore_index=True)
            start = 0
            t = rows["t"].to_numpy()
            while start < len(rows):
                stop = min(start + index.leaf, start + int(np.searchsorted(t[start:], t[start], side="right")))
                if stop == len(rows) and stop - start < index.leaf:
                    break  # it may go on in the next batch
                leaf = _Leaf(rows.iloc[start:stop])
                same = table == t[start]
                yield from close(leaf if same else None)
                before, current, table = current if same else None, leaf, t[start]
                start = stop
            held = [rows.iloc[start:]]
        rows = pd.concat(held, ignore_index=True) if held else None
        if rows is not None and len(rows):
            leaf = _Leaf(rows)
            same = table == rows["t"].iloc[0]
            yield from close(leaf if same else None)
            before, current = current if same else None, leaf
        yield from close(None)

    return run


def projected_neighbours(points: DataFrame, index: ProjectedIndex, k: int, exclude_self: bool) -> DataFrame:
    """Up to k near indexed points of each query point: (pid, nid, nw, distance, place), as the exact join gives them.

    ``points`` is (pid, x, w); with ``exclude_self`` its pids are those of the index. The search runs at once and its answers are stored.
    """
    spark = points.sparkSession
    role = lambda df, asks, found: df.select("pid", "x", "w", F.lit(asks).alias("asks"), F.lit(found).alias("found"))
    indexed = spark.read.parquet(index.path)
    rows = role(indexed, True, True) if exclude_self else role(indexed, False, True).unionByName(role(points, True, False))
    order = ["t", "key", "at", "pid"]
    best = Window.partitionBy("pid").orderBy("distance", "nid")
    known, path = None, None
    total, _, width = index.directions.shape
    step = max(ROUND, ROUND_VALUES // max(1, index.points * width))
    for start in range(0, total, step):
        tables = range(start, min(start + step, total))
        tasks = min(MAX_TASKS, max(1, math.ceil(index.points * len(tables) / (index.leaf * TASK_LEAVES))))
        sorted_ = rows.mapInPandas(_keyed(index, tables), KEYED).repartitionByRange(tasks, *order).sortWithinPartitions(*order)
        met = sorted_.mapInPandas(_leaves(index, k, exclude_self), ANSWERS)
        # Dealt by the asking point once, for both the copies of an answer and the k best.
        dealt = (met if known is None else met.unionByName(known)).repartition("pid")
        once = dealt.groupBy("pid", "nid").agg(F.max("nw").alias("nw"), F.min("distance").alias("distance"))
        placed = once.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k)
        before, path = path, scratch_path(spark, "projected")
        placed.write.parquet(path)
        del sorted_, met, dealt, once, placed  # or the round's shuffle files stay
        found = spark.read.parquet(path)
        known = found.drop("place")
        if before:
            drop_scratch(spark, before)
        if step < total:
            release(spark)
    return found
