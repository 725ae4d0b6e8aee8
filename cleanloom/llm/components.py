"""Connected components of an edge table by alternating star contraction.

Every round replaces the edges of a vertex by edges to its smallest neighbour, first towards larger
neighbours, then towards smaller ones. Edges never grow in number, the rounds grow with the logarithm of the
longest path, and each round is written to the shared folder. A vertex with very many edges is combined
before the shuffle where minima are taken, and its rows are dealt by a join that Spark may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanloom.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("at"), F.least("a", "m").alias("m"))
    return (both.join(least, F.col("a") == F.col("at")).filter("b > a AND b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges run from the larger vertex ``a`` to the smaller ``b``."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "at")
    moved = edges.join(least, F.col("a") == F.col("at")).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("at", "m")).distinct()


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(vertex, root) of all vertices that have an edge; the root is the smallest vertex of its component."""
    ordered = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    held = stored(ordered, "edges")
    state = _state(held)
    while state[0]:
        held = stored(_small_star(_large_star(held)), "edges")
        after = _state(held)
        if after == state:
            break
        state = after
    return held.select(F.col("a").alias("vertex"), F.col("b").alias("root")).union(held.select("b", "b").distinct())
