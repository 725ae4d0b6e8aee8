"""Queries of multivariate outliers: the forest on whole order lines, the local factor on embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from cleanloom.operators import outliers
from cleanloom.operators.lof import fit_density, training_scores
from cleanloom.operators.neighbours import build_index, collapse, neighbours
from cleanloom.operators.projections import build_projections, projected_neighbours
from cleanloom.workload import views as v

KEY = "o_orderkey"
LINE_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
FEATURES = [f"f{i}" for i in range(1, 65)]
NEIGHBOURS = 10
NOVELTY_NEIGHBOURS = 20


def o1_prepared(spark, sf_dir):
    df = v.dirty_orders(spark, sf_dir, KEY, "customer_age", "net_price", "tax_rate")
    return outliers.prepare(df, ["customer_age", "net_price", "tax_rate"])


def _lines(spark, sf_dir):
    """Order lines with a few planted extremes."""
    return v.table(spark, sf_dir, "lineitem").select(*LINE_KEY, *[
        F.when(F.col("l_orderkey") % 500 == 0, F.col(c) * 20 + 50).otherwise(F.col(c)).alias(c) for c in LINE_FEATURES])


def o2_isolation_forest(spark, sf_dir):
    """Share of planted extremes found, and share of rows marked."""
    df = _lines(spark, sf_dir)
    model = outliers.fit(df, key=list(LINE_KEY), features=LINE_FEATURES)
    marked = outliers.detect(df, model)
    planted = F.col("l_orderkey") % 500 == 0
    return marked.agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(planted, 1)).alias("planted"),
        (F.count(F.when(planted & (F.col("Outlier") == -1), 1)) == F.count(F.when(planted, 1))).alias("all_planted_found"),
        (F.abs(F.count(F.when(F.col("Outlier") == -1, 1)) / F.count(F.lit(1)) - 0.05) < 0.005).alias("share_as_asked"))


def _vectors(spark, sf_dir):
    """Every component of every embedding as a feature column."""
    return v.table(spark, sf_dir, "embeddings").select(
        "vec_id", *[F.col("embedding")[i].cast("double").alias(f) for i, f in enumerate(FEATURES)])


def o3_local_factor(spark, sf_dir):
    df = _vectors(spark, sf_dir).select("vec_id", F.array(*FEATURES).alias("x"))
    scores = training_scores(fit_density(df, NEIGHBOURS), spark)
    return df.join(scores, "x").select("vec_id", F.round(-F.col("score"), 6).alias("factor"))


def _marked(spark, sf_dir):
    df = _vectors(spark, sf_dir)
    model = outliers.fit(df, method="lof", features=FEATURES, neighbours=NEIGHBOURS, novelty=False)
    return outliers.detect(df, model)


def o4_detect(spark, sf_dir):
    return _marked(spark, sf_dir).select("vec_id", "Outlier")


def o5_inliers(spark, sf_dir):
    return outliers.inliers(_marked(spark, sf_dir)).select("vec_id")


def o6_summary(spark, sf_dir):
    return outliers.summary(_marked(spark, sf_dir)).select("total", "outliers", F.round("percent", 6).alias("percent"))


def o7_unknown_method(spark, sf_dir):
    """Rows of the table, and whether an unknown method is refused."""
    df = _lines(spark, sf_dir)
    try:
        outliers.fit(df, key=list(LINE_KEY), method="nearest", features=LINE_FEATURES)
        refused = False
    except ValueError:
        refused = True
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("refused", F.lit(refused))


def o8_novelty(spark, sf_dir):
    """The default mode of the local factor: rows are scored as new points, among which each meets itself."""
    df = _vectors(spark, sf_dir)
    model = outliers.fit(df, method="lof", features=FEATURES, neighbours=NOVELTY_NEIGHBOURS)
    return outliers.detect(df, model).select("vec_id", "Outlier")


def o3_projections(spark, sf_dir):
    """Neighbours found by random projections against those of the exact join: points, whether common pairs have the same distance, and
    whether nine in ten are found."""
    points, path = collapse(_vectors(spark, sf_dir).select(F.array(*FEATURES).alias("x")))
    exact = neighbours(points, build_index(points, NEIGHBOURS), NEIGHBOURS, exclude_self=True)
    near = projected_neighbours(points, build_projections(points, path), NEIGHBOURS, exclude_self=True)
    both = exact.join(near.select("pid", "nid", F.col("distance").alias("found")), ["pid", "nid"], "left")
    return both.agg(F.count_distinct("pid").alias("points"), (F.max(F.abs(F.col("found") - F.col("distance"))) < 1e-9).alias("distances_agree"),
                    (F.count("found") >= 0.9 * F.count(F.lit(1))).alias("recall_reached"))


QUERIES = {"o3_projections": o3_projections, "o7_unknown_method": o7_unknown_method, "o8_novelty": o8_novelty, "o1_prepared": o1_prepared, "o2_isolation_forest": o2_isolation_forest, "o3_local_factor": o3_local_factor,
           "o4_detect": o4_detect, "o5_inliers": o5_inliers, "o6_summary": o6_summary}



def _lof(k):
    """Every step of the factor over all pairs, and the share that is marked."""
    return (
        "WITH p AS (SELECT vec_id AS i, embedding::DOUBLE[] AS x FROM embeddings), "
        "d AS (SELECT a.i, b.i AS j, list_distance(a.x, b.x) AS d FROM p a JOIN p b ON a.i <> b.i), "
        f"k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r FROM d) WHERE r <= {k}), "
        "kd AS (SELECT i, max(d) AS kd FROM k GROUP BY i), "
        "lrd AS (SELECT k.i, 1 / (avg(greatest(kd.kd, k.d)) + 1e-10) AS lrd FROM k JOIN kd ON kd.i = k.j GROUP BY k.i), "
        "lof AS (SELECT k.i AS vec_id, avg(n.lrd) / any_value(o.lrd) AS factor FROM k JOIN lrd n ON n.i = k.j JOIN lrd o ON o.i = k.i GROUP BY k.i), "
        "marked AS (SELECT vec_id, CASE WHEN -factor < (SELECT quantile_cont(-factor, 0.05) FROM lof) THEN -1 ELSE 1 END AS outlier FROM lof) ")


_LOF = _lof(NEIGHBOURS)
# A row as a new point: itself at distance zero, then all but the farthest of its neighbours.
_NOVEL = (_lof(NOVELTY_NEIGHBOURS) + f", u AS (SELECT i, j, d FROM k WHERE r < {NOVELTY_NEIGHBOURS} UNION ALL SELECT i, i, 0.0 FROM p), "
          "s AS (SELECT u.i AS vec_id, avg(n.lrd) * (avg(greatest(kd.kd, u.d)) + 1e-10) AS factor FROM u JOIN kd ON kd.i = u.j "
          "JOIN lrd n ON n.i = u.j GROUP BY u.i) ")
SQL = {
    "o3_projections": "SELECT count(DISTINCT embedding) AS points, true AS distances_agree, true AS recall_reached FROM embeddings",
    "o7_unknown_method": "SELECT count(*) AS rows, true AS refused FROM lineitem",
    "o2_isolation_forest": "SELECT count(*) AS rows, count(*) FILTER (l_orderkey % 500 = 0) AS planted, true AS all_planted_found, "
                           "true AS share_as_asked FROM lineitem",
    "o8_novelty": _NOVEL + "SELECT vec_id, CASE WHEN -factor < (SELECT quantile_cont(-factor, 0.05) FROM lof) THEN -1 ELSE 1 END "
                           "AS \"Outlier\" FROM s",
    "o1_prepared": f"{v.CTE} SELECT o_orderkey, " + ", ".join(
        f"coalesce(CAST({c} AS DOUBLE), (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.5) FROM dirty)) AS {c}"
        for c in ("customer_age", "net_price", "tax_rate")) + " FROM dirty",
    "o3_local_factor": _LOF + "SELECT vec_id, round(factor, 6) AS factor FROM lof",
    "o4_detect": _LOF + "SELECT vec_id, outlier AS \"Outlier\" FROM marked",
    "o5_inliers": _LOF + "SELECT vec_id FROM marked WHERE outlier = 1",
    "o6_summary": _LOF + "SELECT count(*) AS total, count(*) FILTER (outlier = -1) AS outliers, "
                  "round(count(*) FILTER (outlier = -1) * 100.0 / count(*), 6) AS percent FROM marked",
}
