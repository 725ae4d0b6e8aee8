import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cleanloom.operators import outliers
from cleanloom.operators.isolation import average_path
from cleanloom.operators.lof import fit_density, new_scores, training_scores


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 3))
    x[:300] = x[0]  # a third of all rows are copies
    x[300:330] = x[300]
    x[-10:] += 15
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "rid long, a double, b double, c double")
    return df.repartition(8).cache(), x


def brute(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    apart = d.copy()
    np.fill_diagonal(apart, np.inf)
    near = np.argsort(apart, axis=1, kind="stable")[:, :k]
    dist = np.take_along_axis(apart, near, 1)
    kdist = dist[:, -1]
    lrd = 1 / (np.maximum(kdist[near], dist).mean(1) + 1e-10)
    own = -(lrd[near].mean(1) / lrd)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    dist = np.take_along_axis(d, near, 1)
    as_new = -(lrd[near].mean(1) * (np.maximum(kdist[near], dist).mean(1) + 1e-10))
    return own, as_new


@pytest.mark.parametrize("pivots", [1, 40])
def test_local_factor_equals_brute_force(spark, points, pivots):
    df, x = points
    vectors = df.select("rid", F.array("a", "b", "c").alias("x"))
    model = fit_density(vectors, 20, pivots)
    own, as_new = brute(x, 20)
    for scores, expected in ((training_scores(model, spark), own), (new_scores(vectors, model), as_new)):
        got = vectors.join(scores, "x").orderBy("rid").select("score").toPandas()["score"].to_numpy()
        np.testing.assert_allclose(got, expected, rtol=1e-9)


def test_local_factor_marks(points):
    df, x = points
    model = outliers.fit(df, method="lof", features=["a", "b", "c"])
    own, as_new = brute(x, 20)
    marked = outliers.detect(df, model)
    expected = set(np.flatnonzero(as_new < np.quantile(own, 0.05)))
    assert {r.rid for r in marked.filter("Outlier = -1").collect()} == expected
    assert outliers.inliers(marked).count() == len(x) - len(expected)


def test_forest_finds_planted_rows_and_the_asked_share(points):
    df, x = points
    model = outliers.fit(df, key=["rid"], features=["a", "b", "c"])
    marked = outliers.detect(df, model)
    assert marked.filter("rid >= 890 and Outlier = -1").count() == 10
    row = outliers.summary(marked).first()
    assert row.total == 900 and abs(row.percent - 5) < 1
    again = outliers.fit(df.repartition(3), key=["rid"], features=["a", "b", "c"])
    assert again.threshold == pytest.approx(model.threshold, abs=1e-12)


def test_missing_values_take_the_median(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, None, None), (3, 3.0, None)], "k int, a double, b double")
    rows = outliers.prepare(df, ["a", "b"]).orderBy("k").collect()
    assert [(r.a, r.b) for r in rows] == [(1.0, 0.0), (2.0, 0.0), (3.0, 0.0)]


def test_refusals(spark, points):
    df, _ = points
    with pytest.raises(ValueError, match="unknown method"):
        outliers.fit(df, key=["rid"], method="dbscan")
    with pytest.raises(ValueError, match="no numeric"):
        outliers.fit(spark.createDataFrame([("a",)], "t string"), key=["t"])
    with pytest.raises(ValueError, match="key"):
        outliers.fit(df)
    with pytest.raises(outliers.NotFitted):
        outliers.detect(df, None)
    model = outliers.fit(df, key=["rid"], features=["a", "b", "c"])
    with pytest.warns(UserWarning, match="fewer than two"):
        assert outliers.detect(df.select("rid", "a"), model).filter("Outlier = 1").count() == 900
    with pytest.raises(ValueError, match="missing"):
        outliers.detect(df.select("rid", "a", "b"), model)


def test_average_path():
    assert list(average_path([0, 1, 2])) == [0.0, 0.0, 1.0] and average_path(256) == pytest.approx(10.244, abs=1e-3)


def _cloud(spark, n, seed=7):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(20, 24)) * 4
    x = centres[draw.integers(0, 20, n)] + draw.normal(size=(n, 24))
    return spark.createDataFrame([(v.tolist(),) for v in x] + [(x[0].tolist(),)] * 50, "x array<double>"), x


def test_projections_against_the_exact_join(spark, monkeypatch):
    from cleanloom.operators import projections
    from cleanloom.operators.neighbours import build_index, collapse, neighbours

    df, x = _cloud(spark, 4000)
    points, path = collapse(df)
    key = lambda found: {(r["pid"], r["nid"]): r["distance"] for r in found.collect()}
    exact = key(neighbours(points, build_index(points, 10), 10, True))
    index = projections.build_projections(points, path, leaf=128)
    assert index.middles.shape == (projections.TABLES, 4)
    near = key(projections.projected_neighbours(points, index, 10, True))
    assert len(near) == len(exact) == 40000 and len(set(near) & set(exact)) >= 0.9 * len(exact)
    assert all(abs(near[p] - exact[p]) < 1e-12 for p in set(near) & set(exact))
    # One leaf holds a small table, and then nothing is missed.
    small, path = collapse(spark.createDataFrame([(v.tolist(),) for v in x[:100]], "x array<double>"))
    found = projections.projected_neighbours(small, projections.build_projections(small, path, tables=1, leaf=4000), 10, True)
    assert set(key(found)) == set(key(neighbours(small, build_index(small, 10), 10, True)))


def test_rounds_of_projections_bound_the_disk(spark, monkeypatch):
    """Whatever the number of tables, a shuffle holds the points of one round, and only the last answers stay written."""
    from cleanloom import session
    from cleanloom.operators import projections
    from cleanloom.operators.neighbours import build_index, collapse, neighbours

    rounds, keyed = [], projections._keyed
    monkeypatch.setattr(projections, "_keyed", lambda index, tables: rounds.append(list(tables)) or keyed(index, tables))
    monkeypatch.setattr(projections, "ROUND", 2)
    monkeypatch.setattr(projections, "ROUND_VALUES", 0)
    df, x = _cloud(spark, 300)
    points, path = collapse(df)
    before = set(session._written)
    # A leaf holds half of the points; those beside it bring the rest, so each table finds nearly all.
    found = projections.projected_neighbours(points, projections.build_projections(points, path, tables=5, leaf=150), 10, True)
    assert rounds == [[0, 1], [2, 3], [4]]
    assert len([p for p in set(session._written) - before if "projected" in p]) == 1
    rows = found.toPandas().sort_values(["pid", "place"])
    assert not rows.duplicated(["pid", "nid"]).any() and (rows.groupby("pid")["place"].agg(list).map(lambda v: v == list(range(1, 11)))).all()
    exact = neighbours(points, build_index(points, 10), 10, True).toPandas().sort_values(["pid", "place"])
    assert rows[["pid", "nid", "nw", "distance"]].reset_index(drop=True).equals(exact[["pid", "nid", "nw", "distance"]].reset_index(drop=True))


def test_rows_take_the_score_of_their_vector_once_for_each_copy(spark, monkeypatch):
    """The threshold is over rows; no vector is shuffled for it, and many copies make no long array."""
    from cleanloom.operators import lof

    monkeypatch.setattr(lof, "COPIES", 3)
    rows = [([float(i), i % 7 * 1.5],) for i in range(40)] + [([0.0, 0.0],)] * 10 + [([5.0, 7.5],)] * 2
    vectors = spark.createDataFrame(rows, "x array<double>")
    model = lof.fit_density(vectors, 4)
    scores = lof.row_scores(model, spark)
    joined = vectors.join(lof.training_scores(model, spark), "x").select("score")
    assert sorted(r.score for r in scores.collect()) == sorted(r.score for r in joined.collect()) and scores.count() == 52
    assert "Exchange" not in scores._jdf.queryExecution().executedPlan().toString()
    assert "x" not in spark.read.parquet(model.path).columns


def test_a_point_meets_a_bounded_number_of_others(spark, monkeypatch):
    from cleanloom.operators import projections
    from cleanloom.operators.neighbours import collapse

    met = []
    whole = projections._answers
    monkeypatch.setattr(projections, "_answers", lambda leaf, around, *a: met.append(sum(len(o.pid) for o in around)) or whole(leaf, around, *a))
    rows = pd.DataFrame({"pid": range(1000), "x": [np.ones(3) * i for i in range(1000)], "w": 1, "asks": True, "found": True, "t": [0] * 700 + [1] * 300})
    index = projections.ProjectedIndex("", np.zeros((2, 1, 3)), np.zeros((2, 0)), 1000, 50)
    found = pd.concat(projections._leaves(index, 5, True)(iter([rows.iloc[:333], rows.iloc[333:340], rows.iloc[340:]])))
    assert max(met) <= 150 and len(met) == 20 and (found.groupby("pid").size() == 5).all() and len(found) == 5000


def test_local_factor_by_projections(spark):
    df, x = _cloud(spark, 1500)
    table = df.select(*[F.col("x")[i].alias(f"c{i}") for i in range(24)])
    for novelty in (False, True):
        marks = [{r[:-1] for r in outliers.detect(table, outliers.fit(table, method="lof", search=search, novelty=novelty)).filter("Outlier = -1").collect()}
                 for search in ("exact", "projections")]
        assert len(marks[0]) > 50 and len(marks[0] & marks[1]) >= 0.95 * len(marks[0] | marks[1])
    with pytest.raises(ValueError, match="unknown search"):
        outliers.fit(table, method="lof", search="guess")


def test_no_point_is_copied_for_the_exact_search(spark):
    from cleanloom.operators.neighbours import build_index, collapse, neighbours

    df, x = _cloud(spark, 1200)
    points, _ = collapse(df)
    index = build_index(points, 10, chunk_points=100)
    found = neighbours(points, index, 10, True)
    plan = found._jdf.queryExecution().executedPlan().toString()
    # Blocks of queries are dealt out once; the indexed points are read where they lie, by nested loop.
    assert plan.count("Exchange") == 1 and "CartesianProduct" in plan and "SortMergeJoin" not in plan
    blocks = spark.read.parquet(index.path)
    assert blocks.count() >= 12 and blocks.agg(F.sum(F.octet_length("pid")) / 8).first()[0] == points.count() == 1200
    rows = found.toPandas().sort_values(["pid", "place"])
    assert len(rows) == 12000 and set(rows["place"]) == set(range(1, 11))
    at = {tuple(r.x): r.pid for r in points.collect()}
    pid = np.array([at[tuple(v)] for v in x])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :10]
    expected = {(pid[i], pid[j]) for i in range(len(x)) for j in near[i]}
    assert set(zip(rows["pid"], rows["nid"])) == expected


@pytest.mark.parametrize("shift", [0.0, 1e7, 1e160])
def test_a_block_keeps_ties_and_far_points(shift):
    """Whole numbers tie everywhere; far from zero, or where squares overflow, the product alone would go wrong."""
    from cleanloom.operators.neighbours import _Chunk

    draw = np.random.default_rng(3)
    scale = 1.0 if shift < 1e100 else shift
    x = draw.integers(0, 6, (400, 3)) * scale + (shift if scale == 1.0 else 0.0)
    x = np.unique(x, axis=0)
    ids = np.arange(len(x))
    chunk = _Chunk(ids[:70], x[:70].copy(), 7, True, np.inf, np.zeros(1))
    for start in range(0, len(x), 60):
        part = slice(start, start + 60)
        chunk.meet(ids[part], np.ones(len(ids[part]), dtype=np.int64), x[part], np.zeros(len(ids[part])))
    got = pd.concat(b.to_pandas() for b in chunk.result())
    with np.errstate(over="ignore"):
        d = np.sqrt(((x[:70, None] - x[None]) ** 2).sum(-1))
    d[np.arange(70), np.arange(70)] = np.inf
    for i in range(70):
        order = np.lexsort((ids, d[i]))[:7]
        mine = got[got["pid"] == i].sort_values("place")
        finite = order[np.isfinite(d[i][order])]
        assert list(mine["nid"]) == list(finite) and np.array_equal(mine["distance"], d[i][finite])


@pytest.mark.parametrize("points", [800, 2400])
def test_a_block_is_bounded_whatever_the_table(spark, points):
    from cleanloom.operators.neighbours import build_index, collapse

    df, _ = _cloud(spark, points)
    index = build_index(collapse(df)[0], 10, pivots=2, chunk_points=100)  # cells much larger than a block
    sizes = [r.n for r in spark.read.parquet(index.path).select((F.octet_length("pid") / 8).alias("n")).collect()]
    assert sum(sizes) == points and max(sizes) <= 150 and len(sizes) >= points / 100
