"""Exact k-nearest-neighbour join over feature vectors, pruned by pivots.

Equal vectors are collapsed to one point with a weight first, so copies cost nothing. Pivots are drawn
from the distinct points, so dense regions get more of them and cells stay of similar size; each point
belongs to the cell of its nearest pivot. Cells are cut into blocks of bounded size, each a row that is written once.
From per-cell summaries the triangle inequality bounds how far the neighbours of a block can lie, and only
blocks within that bound meet it.

Blocks meet in a nested loop: a task holds one block of queries and reads the indexed blocks one after another
from shared storage, keeping the k best. No point is copied or sorted for the search, so disk grows with the points and a task's
memory with the size of a block, even where distances prune nothing and all pairs have to be met. A matrix product with
a bound on its error picks the pairs that may count; their distances are then taken by differences.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cleanloom.session import drop_scratch, scratch_path

CHUNK_POINTS = 2000
MIN_CHUNK_POINTS = 100
MAX_CHUNK_VALUES = 128_000  # 1 MB of coordinates in a block: Parquet's writer and reader hold a hundred blocks or more
MAX_TASKS = 20_000
MAX_PIVOTS = 16384
MAX_PIVOT_VALUES = 4_000_000  # 32 MB of pivot coordinates
BLOCK_VALUES = 4_000_000
BLOCK = ("cell int, part int, u double, reach double, partners array<int>, width int, "
         "pid binary, w binary, r binary, x binary")


@dataclass(frozen=True)
class Index:
    """Points in blocks, on shared storage, with the bounded summary that travels to tasks."""

    path: str
    pivots: np.ndarray
    radius: np.ndarray
    # Per cell: distances to the pivot of its nearest points, ascending, padded with infinity.
    nearest: np.ndarray
    points: int
    chunk_points: int


def _blocks(rows: int, width: int):
    step = max(1, BLOCK_VALUES // max(width, 1))
    return ((i, min(i + step, rows)) for i in range(0, rows, step))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances, by differences (no cancellation for close points)."""
    out = np.empty((len(a), len(b)))
    for start, stop in _blocks(len(a), len(b) * max(a.shape[1], 1)):
        gap = a[start:stop, None, :] - b[None, :, :]
        out[start:stop] = np.sqrt(np.einsum("ijk,ijk->ij", gap, gap))
    return out


def _matrix(values: pd.Series) -> np.ndarray:
    return np.vstack(values.to_numpy()).astype(float) if len(values) else np.empty((0, 0))


def _assigned(points: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add the nearest pivot and the distance to it."""
    @F.pandas_udf("cell int, r double")
    def assign(x: pd.Series) -> pd.DataFrame:
        m = _matrix(x)
        cell, r = np.empty(len(m), dtype=np.int32), np.empty(len(m))
        for start, stop in _blocks(len(m), pivots.size):
            d = distances(m[start:stop], pivots)
            cell[start:stop] = d.argmin(axis=1)
            r[start:stop] = d.min(axis=1)
        return pd.DataFrame({"cell": cell, "r": r})

    return points.withColumn("a", assign("x")).select("pid", "x", "w", F.col("a.cell").alias("cell"), F.col("a.r").alias("r"))


def collapse(vectors: DataFrame) -> tuple[DataFrame, str]:
    """Distinct vectors (pid, x, w) on shared storage, and where they lie; ``vectors`` has a complete array column ``x``."""
    spark = vectors.sparkSession
    path = scratch_path(spark, "points")
    # The number is frozen by the write; equal vectors are combined before the shuffle.
    vectors.groupBy("x").agg(F.count(F.lit(1)).alias("w")).withColumn(
        "pid", F.monotonically_increasing_id()).write.parquet(path)
    return spark.read.parquet(path), path


def _packed(cells: DataFrame, index: Index, needed: int) -> str:
    """Write points (pid, x, w, cell, r) as rows of one block each, and say where.

    A block knows the cells in which the ``needed`` nearest indexed points of its own points must lie.
    """
    spark = cells.sparkSession
    pivots, radius, nearest = index.pivots, index.radius, index.nearest
    sizes = cells.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / index.chunk_points).alias("parts"))
    parted = cells.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("pid"), F.col("parts")).cast("int"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pid")
        cell, u, x = int(pdf["cell"].iloc[0]), float(pdf["r"].max()), _matrix(pdf["x"])
        apart = distances(pivots[cell:cell + 1], pivots)[0]
        reach = u + np.partition((apart[:, None] + nearest).ravel(), needed - 1)[needed - 1]
        reach *= 1 + 1e-9  # rounding must not lose a tie
        partners = np.flatnonzero(apart - u - radius <= reach).astype(np.int32)
        return pd.DataFrame([{
            "cell": cell, "part": int(pdf["part"].iloc[0]), "u": u, "reach": reach, "partners": partners, "width": x.shape[1],
            "pid": pdf["pid"].to_numpy(np.int64).tobytes(), "w": pdf["w"].to_numpy(np.int64).tobytes(),
            "r": pdf["r"].to_numpy(float).tobytes(), "x": x.tobytes()}])

    path = scratch_path(spark, "blocks")
    parted.drop("parts").groupBy("cell", "part").applyInPandas(pack, BLOCK).write.parquet(path)
    return path


def build_index(points: DataFrame, k: int, seed: int = 42, pivots: int | None = None, chunk_points: int | None = None) -> Index:
    spark = points.sparkSession
    facts = points.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d")).first()
    n, d = facts["n"], max(facts["d"] or 1, 1)
    if chunk_points is None:  # a few chunks per core, within bounds
        share = n // (4 * spark.sparkContext.defaultParallelism)
        chunk_points = max(1, min(CHUNK_POINTS, max(MIN_CHUNK_POINTS, share), MAX_CHUNK_VALUES // d))
    wanted = min(pivots or math.ceil(n / chunk_points), MAX_PIVOTS, max(1, MAX_PIVOT_VALUES // d), n)
    draw = F.pmod(F.xxhash64("pid", F.lit(seed)), F.lit(1 << 30))
    share = min(1.0, (2.0 * wanted + 64) / n)
    chosen = (points.select("pid", "x", draw.alias("h")).filter(F.col("h") < F.lit(int(share * (1 << 30)) + 1))
              .orderBy("h", "pid").limit(wanted).select("x").toPandas())
    centres = _matrix(chosen["x"])
    path = scratch_path(spark, "cells")
    _assigned(points, centres).write.parquet(path)
    cells = spark.read.parquet(path)
    order = Window.partitionBy("cell").orderBy("r")
    # At most k + 1 distances per cell, limited in every task before the shuffle.
    close = (cells.select("cell", "r", F.row_number().over(order).alias("place"))
             .filter(F.col("place") <= k + 1).toPandas())
    nearest = np.full((len(centres), k + 1), np.inf)
    nearest[close["cell"], close["place"] - 1] = close["r"]
    radius = np.zeros(len(centres))
    for row in cells.groupBy("cell").agg(F.max("r").alias("r")).collect():
        radius[row["cell"]] = row["r"]
    index = Index("", centres, radius, nearest, n, chunk_points)
    index = replace(index, path=_packed(cells, index, min(k + 1, n)))
    drop_scratch(spark, path)
    return index


def neighbours(points: DataFrame, index: Index, k: int, exclude_self: bool) -> DataFrame:
    """The k nearest indexed points of each query point: (pid, nid, nw, distance, place).

    ``points`` is (pid, x, w); with ``exclude_self`` its pids are those of the index. Ties go to the
    smaller pid, so the result does not depend on partitioning. ``k`` is at most that of the index.
    """
    spark = points.sparkSession
    path = index.path
    if not exclude_self:
        cells = scratch_path(spark, "query")
        _assigned(points, index.pivots).write.parquet(cells)
        path = _packed(spark.read.parquet(cells), index, min(k, index.points))
        drop_scratch(spark, cells)
    asking = spark.read.parquet(path).select("cell", "part", "u", "reach", "partners", "width", "pid", "x")
    # The search is bound by CPU, not bytes: one task per block of queries, up to a limit.
    asking = asking.repartitionByRange(min(MAX_TASKS, max(1, asking.count())), "cell", "part")
    indexed = spark.read.parquet(index.path).select(
        F.col("cell").alias("other"), *[F.col(c).alias(f"o_{c}") for c in ("pid", "w", "r", "x")])
    # The left side is streamed past each part of the right one, which alone is held; one stream, so a query is answered in one place.
    met = indexed.coalesce(1).join(
        asking.hint("shuffle_replicate_nl"), F.array_contains("partners", F.col("other")))
    pivots = index.pivots

    def search(batches):
        held: dict[tuple[int, int], _Chunk] = {}
        for batch in batches:
            column = {name: batch.column(name) for name in batch.schema.names}
            for i in range(batch.num_rows):
                value = lambda name, i=i: column[name][i].as_py()
                raw = lambda name, kind, i=i: np.frombuffer(column[name][i].as_buffer(), dtype=kind)
                key = (value("cell"), value("part"))
                width = value("width")
                if key not in held:
                    held[key] = _Chunk(raw("pid", np.int64).copy(), raw("x", float).reshape(-1, width).copy(), k, exclude_self,
                                       value("reach"), distances(pivots[key[0]:key[0] + 1], pivots)[0] - value("u"))
                held[key].meet(raw("o_pid", np.int64), raw("o_w", np.int64), raw("o_x", float).reshape(-1, width),
                               held[key].gaps[value("other")] - raw("o_r", float))
        for chunk in held.values():
            yield from chunk.result()

    return met.mapInArrow(search, "pid long, nid long, nw long, distance double, place int")


def _nearest_first(d: np.ndarray, who: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k smallest distances per row, ascending; equal distances by smaller id."""
    if d.shape[1] <= k:
        return np.lexsort((who, d), axis=1)
    order = np.argpartition(d, k - 1, axis=1)[:, :k]
    near = np.take_along_axis(d, order, 1)
    inner = np.lexsort((np.take_along_axis(who, order, 1), near), axis=1)
    order = np.take_along_axis(order, inner, 1)
    # Where more than k candidates lie within the k-th distance, the tie is settled by a full sort.
    tied = np.flatnonzero((d <= near.max(axis=1)[:, None]).sum(axis=1) > k)
    if len(tied):
        order[tied] = np.lexsort((who[tied], d[tied]), axis=1)[:, :k]
    return order


class _Chunk:
    """Query points of one block and the best candidates met so far."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, k: int, exclude_self: bool, reach: float, gaps: np.ndarray):
        self.ids, self.points, self.k, self.exclude_self, self.gaps = ids, points, k, exclude_self, gaps
        self.best = np.full((len(ids), k), np.inf)
        self.who = np.full((len(ids), k), -1, dtype=np.int64)
        self.weight = np.zeros((len(ids), k), dtype=np.int64)
        # No neighbour lies beyond; the k-th distance takes over once it is smaller.
        self.reach = np.full(len(ids), reach)
        self.centre = points.mean(axis=0)
        self.shifted = points - self.centre
        self.squares = np.einsum("ij,ij->i", self.shifted, self.shifted)

    def meet(self, pid: np.ndarray, w: np.ndarray, x: np.ndarray, apart: np.ndarray):
        """``apart`` bounds from below how far each candidate is from any of the query points."""
        limit = np.minimum(self.best[:, -1], self.reach)
        near = apart <= limit.max() * (1 + 1e-9)
        if not near.all():
            pid, w, x = pid[near], w[near], x[near]
        for start, stop in _blocks(len(x), len(self.ids)):
            self._meet(pid[start:stop], w[start:stop], x[start:stop], limit)
            limit = np.minimum(self.best[:, -1], self.reach)

    def _meet(self, pid, w, x, limit):
        shifted = x - self.centre
        squares = np.einsum("ij,ij->i", shifted, shifted)
        with np.errstate(over="ignore", invalid="ignore"):
            d = self.shifted @ shifted.T
            d *= -2
            d += self.squares[:, None]
            d += squares
            # Twice the error of the product and of the shift, which are relative to the lengths after the shift.
            slack = 8 * (x.shape[1] + 8) * np.finfo(float).eps * (self.squares + squares.max())
            if self.exclude_self:
                at = np.minimum(np.searchsorted(pid, self.ids), len(pid) - 1)  # blocks are in order of pid
                own = np.flatnonzero(pid[at] == self.ids)
                d[own, at[own]] = np.inf
            bound = limit * limit * (1 + 1e-9) + slack
            if len(pid) > self.k and np.isinf(self.best[:, -1]).any():
                # Without k candidates yet, the k nearest of these give a bound as well.
                bound = np.fmin(bound, np.partition(d, self.k - 1, axis=1)[:, self.k - 1] + 2 * slack)
            may = ~(d > bound[:, None])  # what is not a number passes
            if self.exclude_self:
                may[own, at[own]] = False
        row, column = np.nonzero(may)
        step = max(1, BLOCK_VALUES // max(x.shape[1], 1))
        for start in range(0, len(row), step):
            self._merge(row[start:start + step], column[start:start + step], pid, w, x)

    def _merge(self, row, column, pid, w, x):
        gap = self.points[row] - x[column]
        far = np.sqrt(np.einsum("ij,ij->i", gap, gap))
        keep = far <= self.best[row, -1]
        row, column, far = row[keep], column[keep], far[keep]
        if not len(row):
            return
        counts = np.bincount(row, minlength=len(self.ids))
        rows = np.flatnonzero(counts)
        # The new candidates of a query side by side, padded with infinity, behind its best so far.
        at = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        for some, wide in _by_width(rows, counts):
            mine = np.isin(row, some) if len(some) < len(rows) else slice(None)
            line = np.searchsorted(some, row[mine])
            d, who, weight = (np.full((len(some), wide), fill, dtype=kind) for fill, kind in ((np.inf, float), (-1, np.int64), (0, np.int64)))
            d[line, at[mine]], who[line, at[mine]], weight[line, at[mine]] = far[mine], pid[column[mine]], w[column[mine]]
            d = np.hstack([self.best[some], d])
            who = np.hstack([self.who[some], who])
            weight = np.hstack([self.weight[some], weight])
            order = _nearest_first(d, who, self.k)
            self.best[some] = np.take_along_axis(d, order, 1)
            self.who[some] = np.take_along_axis(who, order, 1)
            self.weight[some] = np.take_along_axis(weight, order, 1)

    def result(self):
        found = np.isfinite(self.best)
        row, place = np.nonzero(found)
        schema = pa.schema([("pid", pa.int64()), ("nid", pa.int64()), ("nw", pa.int64()), ("distance", pa.float64()), ("place", pa.int32())])
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (
            self.ids[row], self.who[found], self.weight[found], self.best[found], (place + 1).astype(np.int32))], schema=schema)


def _by_width(rows: np.ndarray, counts: np.ndarray):
    """Queries in groups of similar numbers of candidates, so that padding stays within a factor of two."""
    size = np.ceil(np.log2(counts[rows])).astype(int)
    for exponent in np.unique(size):
        some = rows[size == exponent]
        yield some, int(counts[some].max())
