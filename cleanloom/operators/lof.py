"""Local outlier factor (Breunig et al., 2000) from a neighbour join, exact or by random projections."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cleanloom.operators.neighbours import Index, build_index, collapse, neighbours
from cleanloom.operators.projections import ProjectedIndex, build_projections, projected_neighbours
from cleanloom.session import drop_scratch, scratch_path

NEIGHBOURS = 20
EPSILON = 1e-10
COPIES = 65_536
SEARCHES = ("exact", "projections")


@dataclass(frozen=True)
class Density:
    """Training points with k-distance and local reachability density, on shared storage; their vectors lie under ``points``."""

    path: str
    points: str
    index: Index | ProjectedIndex
    k: int


def _uses(found: DataFrame, k: int, own) -> DataFrame:
    """How often each neighbour counts among the k, given ``own`` copies of the point that come first."""
    before = Window.partitionBy("pid").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum("nw").over(before), F.lit(0))
    left = F.lit(k) - own - earlier
    return found.withColumn("uses", F.greatest(F.lit(0), F.least("nw", left))).filter("uses > 0")


def _near(points: DataFrame, index: Index | ProjectedIndex, k: int, exclude_self: bool) -> DataFrame:
    return (neighbours if isinstance(index, Index) else projected_neighbours)(points, index, k, exclude_self=exclude_self)


def fit_density(vectors: DataFrame, k: int, pivots: int | None = None, seed: int = 42, search: str = "exact") -> Density:
    """Fit on rows with a complete feature vector ``x``; a point is not its own neighbour, its copies are.

    ``search`` is how neighbours are found: ``exact``, or ``projections``, which is linear in the points and may miss some.
    """
    if search not in SEARCHES:
        raise ValueError(f"unknown search: {search}")
    spark = vectors.sparkSession
    points, vectors_path = collapse(vectors)
    index = build_index(points, k, seed, pivots) if search == "exact" else build_projections(points, vectors_path, seed)
    own = F.least(F.col("w") - 1, F.lit(k))
    found = _near(points, index, k, exclude_self=True)
    path = scratch_path(spark, "neighbours")
    # `points` holds the weight of the point itself; nw is the weight of the neighbour.
    _uses(found.join(points.select("pid", "w"), "pid"), k, own).select(
        "pid", "nid", "distance", "uses").write.parquet(path)
    uses = spark.read.parquet(path)
    reach = uses.groupBy("pid").agg(F.max("distance").alias("far"))
    # Vectors stay where they are: only numbers are shuffled from here on.
    kdist = points.select("pid", "w").join(reach, "pid", "left").select(
        "pid", "w", own.alias("own"), F.coalesce("far", F.lit(0.0)).alias("kdist"))
    near = uses.join(kdist.select(F.col("pid").alias("nid"), F.col("kdist").alias("nk")), "nid")
    sums = near.groupBy("pid").agg(F.sum(F.col("uses") * F.greatest("nk", "distance")).alias("reach"),
                                   F.sum("uses").alias("others"))
    total = F.coalesce("reach", F.lit(0.0)) + F.col("own") * F.col("kdist")
    counted = F.coalesce("others", F.lit(0)) + F.col("own")
    lrd = kdist.join(sums, "pid", "left").select(
        "pid", "w", "own", "kdist", counted.alias("counted"),
        (1.0 / (total / counted + EPSILON)).alias("lrd"))
    lrd_path = scratch_path(spark, "density")
    lrd.write.parquet(lrd_path)
    dense = spark.read.parquet(lrd_path)
    ratio = uses.join(dense.select(F.col("pid").alias("nid"), F.col("lrd").alias("nl")), "nid").groupBy("pid").agg(
        F.sum(F.col("uses") * F.col("nl")).alias("nl"))
    scored = dense.join(ratio, "pid", "left").withColumn(
        "score", -(F.coalesce("nl", F.lit(0.0)) + F.col("own") * F.col("lrd")) / F.col("counted") / F.col("lrd"))
    out = scratch_path(spark, "lof")
    scored.select("pid", "w", "kdist", "lrd", "score").write.parquet(out)
    for passed in (path, lrd_path):
        drop_scratch(spark, passed)
    return Density(out, vectors_path, index, k)


def training_scores(model: Density, spark) -> DataFrame:
    """(x, w, score) of the training points; score is the negated factor, lower is more abnormal."""
    scores = spark.read.parquet(model.path).select("pid", "w", "score")
    return spark.read.parquet(model.points).select("pid", "x").join(scores, "pid").select("x", "w", "score")


def row_scores(model: Density, spark) -> DataFrame:
    """(score) of every training row: that of its vector, once for each copy."""
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(w - 1) div {COPIES}"))).alias("part")  # no long array for many copies
    part = spark.read.parquet(model.path).select("score", "w", copies)
    some = F.least(F.lit(COPIES), F.col("w") - F.col("part") * COPIES)
    return part.select("score", F.explode(F.sequence(F.lit(1).cast("long"), some)).alias("copy")).select("score")


def new_scores(vectors: DataFrame, model: Density) -> DataFrame:
    """(x, score) of rows treated as new: a training row counts itself among its neighbours."""
    spark = vectors.sparkSession
    points, _ = collapse(vectors)
    trained = spark.read.parquet(model.path).select(
        F.col("pid").alias("nid"), F.col("kdist").alias("nk"), F.col("lrd").alias("nl"))
    found = _near(points, model.index, model.k, exclude_self=False)
    uses = _uses(found, model.k, F.lit(0)).join(trained, "nid")
    sums = uses.groupBy("pid").agg(
        F.sum(F.col("uses") * F.greatest("nk", "distance")).alias("reach"),
        F.sum(F.col("uses") * F.col("nl")).alias("nl"), F.sum("uses").alias("n"))
    lrd = 1.0 / (F.col("reach") / F.col("n") + EPSILON)
    return points.join(sums, "pid").select("x", (-(F.col("nl") / F.col("n")) / lrd).alias("score"))
