"""Approximate nearest neighbours by robust-pruned directed graphs, one per shard.

The vectors are dealt into shards of bounded size by a hash of their content. Each shard gets a directed graph:
points enter in batches that double in size; a greedy beam search from the medoid over the graph so far
proposes neighbours (all points it expanded or kept); pruning goes through the proposals nearest first, keeps one
and drops all that are ``alpha`` times nearer to a kept one than to the point; edges are added backwards, and lists that
overflow are pruned again. The whole is done twice, first with alpha 1, then with the relaxed alpha. A query runs a beam search
in every shard, and the shards' best are merged.

The largest inner product becomes a nearest neighbour in the plane by one further component, sqrt(M^2 - |x|^2) with
M the largest norm of the shard (zero for queries); graphs are built and searched there, and what comes out is scored again as the inner
product of the original vectors in double precision.

A shard and a block of queries are the largest things one task holds. Equal vectors (however many) are reduced
to their ``k`` + 1 smallest identifiers before sharding, which is all a search for ``k`` can return of them; this is a limit per
group that Spark applies before the shuffle. In a shard equal vectors are one point of the graph.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do vectors of another
length than the most frequent one (ties: the longest), nor rows without identifier. A query never returns its own identifier; with fewer than ``k``
candidates all are returned. Ties go to the smaller identifier. Rows that repeat an identifier and vector count once. An empty
table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cleanloom.llm.common import ref

K = 20
DEGREE = 32
BUILD_BEAM = 48
SEARCH_BEAM = 64
ALPHA = 1.2
SHARD_VECTORS = 4096
QUERY_BLOCK = 512
PRUNED_AT_ONCE = 256
QUERY_STEP = 20  # the query set: identifiers divisible by this

GRAPH = "shard int, vectors binary, members binary, edges binary, start int, dim int"
RESULT = "query_id long, vec_id long, score double"


# ---------------------------------------------------------------- the graph of one shard
@dataclass
class Graph:
    points: np.ndarray  # (n, d) float32, in the plane where near means a large inner product
    edges: np.ndarray  # (n, degree) int32, -1 where there is none
    start: int

    def search(self, queries: np.ndarray, beam: int, keep_expanded: bool = False):
        """Beam search of many queries at once.

        Returns the beams (positions and distances, nearest first); with ``keep_expanded`` also all points expanded.
        """
        m, n = len(queries), len(self.points)
        seen = np.zeros((m, n), bool)
        beams = np.full((m, beam), -1, np.int64)
        far = np.full((m, beam), np.inf, np.float32)
        done = np.zeros((m, beam), bool)
        beams[:, 0], seen[:, self.start] = self.start, True
        far[:, 0] = _distances(queries, self.points[[self.start]])[:, 0]
        trail, active = [], np.arange(m)
        while len(active):
            waiting = np.where(done[active] | (beams[active] < 0), np.inf, far[active])
            best = waiting.argmin(axis=1)
            open_ = np.isfinite(waiting[np.arange(len(active)), best])
            active, best = active[open_], best[open_]
            if not len(active):
                break
            done[active, best] = True
            at = beams[active, best]
            if keep_expanded:
                trail.append((active, at, far[active, best]))
            near = self.edges[at].astype(np.int64)
            fresh = (near >= 0) & ~seen[active[:, None], near]
            row, column = np.nonzero(fresh)
            seen[active[row], near[row, column]] = True
            gap = np.full(near.shape, np.inf, np.float32)
            gap[row, column] = _pair_distances(queries[active[row]], self.points[near[row, column]])
            near[~fresh] = -1
            all_far = np.concatenate([far[active], gap], axis=1)
            all_at = np.concatenate([beams[active], near], axis=1)
            all_done = np.concatenate([done[active], np.zeros(near.shape, bool)], axis=1)
            order = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
            far[active] = np.take_along_axis(all_far, order, 1)
            beams[active] = np.take_along_axis(all_at, order, 1)
            done[active] = np.take_along_axis(all_done, order, 1)
        return (beams, far, trail) if keep_expanded else (beams, far)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T


def _pair_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    gap = a - b
    return np.einsum("ij,ij->i", gap, gap)


def _prune(points: np.ndarray, at: np.ndarray, proposed: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """Diverse neighbours of the points ``at`` from their proposals (-1: none), many points at once."""
    if len(at) > PRUNED_AT_ONCE:
        return np.concatenate([_prune(points, at[i:i + PRUNED_AT_ONCE], proposed[i:i + PRUNED_AT_ONCE], alpha, degree)
                               for i in range(0, len(at), PRUNED_AT_ONCE)])
    gap = np.where(proposed < 0, np.inf, _pair_distances(
        np.repeat(points[at], proposed.shape[1], axis=0), points[proposed.ravel()]).reshape(proposed.shape))
    gap[proposed == at[:, None]] = np.inf
    order = np.argsort(gap, axis=1, kind="stable")
    proposed, gap = np.take_along_axis(proposed, order, 1), np.take_along_axis(gap, order, 1)
    useful = max(1, int(np.isfinite(gap).sum(axis=1).max(initial=1)))
    proposed, gap = proposed[:, :useful], gap[:, :useful]
    vectors = points[np.maximum(proposed, 0)]
    products = vectors @ vectors.transpose(0, 2, 1)
    squares = np.einsum("ijj->ij", products).copy()
    kept = np.full((len(at), degree), -1, np.int32)
    alive, count = np.isfinite(gap), np.zeros(len(at), np.int64)
    rows = np.arange(len(at))
    for _ in range(degree):
        first = alive.argmax(axis=1)
        some = alive[rows, first]
        if not some.any():
            break
        which = rows[some]
        chosen = first[some]
        kept[which, count[which]] = proposed[which, chosen]
        count[which] += 1
        between = squares[which] + squares[which, chosen][:, None] - 2 * products[which, chosen]
        alive[which] &= alpha * alpha * between > gap[which]  # distances are squared
        alive[which, chosen] = False
    return kept


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA) -> Graph:
    """Two passes of batch insertion; batches double, and never hold more than a tenth of the points."""
    n = len(points)
    start = int(_distances(points.mean(0, keepdims=True), points).argmin())
    graph = Graph(points, np.full((n, degree), -1, np.int32), start)
    order = np.random.default_rng(7).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    for slack in (1.0, alpha):
        at, size = (1, 1) if slack == 1.0 else (0, n)
        while at < n:
            batch = order[at:at + min(size, max(1, n // 10), 1024)]
            beams, _, trail = graph.search(points[batch], beam, keep_expanded=True)
            _insert(graph, batch, _proposals(beams, trail, graph.edges[batch], len(batch)), slack)
            at, size = at + len(batch), size * 2
    return graph


def _proposals(beams, trail, edges, m) -> np.ndarray:
    """Beam, old neighbours and the points expanded, as one table padded with -1."""
    owner = np.concatenate([a for a, _, _ in trail])
    place = np.concatenate([p for _, p, _ in trail])
    by_owner = np.argsort(owner, kind="stable")
    owner, place = owner[by_owner], place[by_owner]
    counts = np.bincount(owner, minlength=m)
    column = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    expanded = np.full((m, counts.max()), -1, np.int64)
    expanded[owner, column] = place
    both = np.sort(np.concatenate([beams, edges.astype(np.int64), expanded], axis=1), axis=1)
    both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
    return both


def _insert(graph: Graph, batch: np.ndarray, proposed: np.ndarray, alpha: float) -> None:
    points, degree = graph.points, graph.edges.shape[1]
    graph.edges[batch] = _prune(points, batch, proposed, alpha, degree)
    # Backward edges, grouped by the point they start from.
    row, column = np.nonzero(graph.edges[batch] >= 0)
    source, target = graph.edges[batch][row, column].astype(np.int64), batch[row].astype(np.int64)
    order = np.argsort(source, kind="stable")
    source, target = source[order], target[order]
    heads, first, counts = np.unique(source, return_index=True, return_counts=True)
    added = np.full((len(heads), counts.max() if len(counts) else 0), -1, np.int64)
    added[np.repeat(np.arange(len(heads)), counts), np.arange(len(source)) - np.repeat(first, counts)] = target
    both = np.sort(np.concatenate([graph.edges[heads].astype(np.int64), added], axis=1), axis=1)[:, ::-1]
    both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
    both = -np.sort(-both, axis=1)
    fits = (both >= 0).sum(1) <= degree
    room = np.full((len(heads), degree), -1, np.int32)
    width = min(degree, both.shape[1])
    room[:, :width] = both[:, :width]
    graph.edges[heads[fits]] = room[fits]
    graph.edges[heads[~fits]] = _prune(points, heads[~fits], both[~fits], alpha, degree)


def lifted(vectors: np.ndarray) -> np.ndarray:
    """Points whose distance order from any query is the inner product order, backwards."""
    norms = (vectors.astype(np.float64) ** 2).sum(1)
    rest = np.sqrt(np.maximum(norms.max() - norms, 0))
    scale = math.sqrt(norms.max())
    return np.concatenate([vectors / scale, rest[:, None] / scale], axis=1).astype(np.float32)


# ---------------------------------------------------------------- Spark jobs
def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): rows that take part, v an array of doubles of the prevailing length."""
    cleaned = (rows.select(ref(id_col).cast("long").alias("vec_id"), ref(vector_col).cast("array<double>").alias("v"))
               .filter("vec_id IS NOT NULL AND v IS NOT NULL")
               .filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
                       & F.exists("v", lambda x: x != 0)))
    lengths = cleaned.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return cleaned.filter(F.size("v") == (lengths[0]["d"] if lengths else 0))


def _candidates(rows: DataFrame, k: int, shards: int) -> DataFrame:
    """(shard, vec_id, v) with at most k + 1 rows for equal vectors."""
    shard = F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int")
    few = rows.distinct().withColumn("shard", shard).withColumn(
        "nth", F.row_number().over(Window.partitionBy("v").orderBy("vec_id")))
    return few.filter(F.col("nth") <= k + 1).drop("nth")


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    """One shard's graph as one row. Members are (point, identifier), sorted."""
    vectors = np.stack(pdf["v"].to_numpy()).astype(np.float64)
    distinct, owner = np.unique(vectors, axis=0, return_inverse=True)
    members = np.stack([owner.ravel(), pdf["vec_id"].to_numpy()], axis=1).astype(np.int64)
    members = members[np.lexsort((members[:, 1], members[:, 0]))]
    graph = build_graph(lifted(distinct))
    return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "vectors": [distinct.tobytes()], "members": [members.tobytes()],
                         "edges": [graph.edges.tobytes()], "start": [graph.start], "dim": [distinct.shape[1]]})


def _search(k: int, beam: int):
    def run(key, index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(index) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        row = index.iloc[0]
        vectors = np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dim"])
        members = np.frombuffer(row["members"], np.int64).reshape(-1, 2)
        edges = np.frombuffer(row["edges"], np.int32).reshape(len(vectors), -1)
        starts = np.searchsorted(members[:, 0], np.arange(len(vectors) + 1))
        graph = Graph(lifted(vectors), edges, int(row["start"]))
        wanted = np.stack(queries["v"].to_numpy()).astype(np.float64)
        length = np.sqrt((wanted ** 2).sum(1, keepdims=True))
        beams, _ = graph.search(np.concatenate([wanted / length, np.zeros((len(wanted), 1))], axis=1).astype(np.float32), beam)
        found = []
        for q, name in enumerate(queries["vec_id"].to_numpy()):
            points = beams[q][beams[q] >= 0]
            scores = (vectors[points] * wanted[q]).sum(1)
            ids = np.concatenate([members[starts[p]:starts[p + 1], 1] for p in points])
            scores = np.repeat(scores, starts[points + 1] - starts[points])
            ids, scores = ids[ids != name], scores[ids != name]
            best = np.lexsort((ids, -scores))[:k]
            found.append((np.full(len(best), name), ids[best], scores[best]))
        query, ids, scores = (np.concatenate(c) for c in zip(*found))
        return pd.DataFrame({"query_id": query, "vec_id": ids, "score": scores})

    return run


def nearest(rows: DataFrame, queries: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K,
            shard_vectors: int = SHARD_VECTORS, block: int = QUERY_BLOCK, beam: int = SEARCH_BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products found for each query among all other rows.

    ``queries`` tells which rows ask, by a condition on ``vec_id``.
    """
    asks = F.col("vec_id") % QUERY_STEP == 0 if queries is None else queries
    good = usable(rows, id_col, vector_col)
    sizes = good.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(asks, 1)).alias("q")).first()
    shards, blocks = max(1, math.ceil(sizes["n"] / shard_vectors)), max(1, math.ceil(sizes["q"] / block))
    graphs = _candidates(good, k, shards).groupBy("shard").applyInPandas(_build, GRAPH)
    index = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = (good.filter(asks).distinct().withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
             .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))))
    found = index.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInPandas(_search(k, beam), RESULT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
