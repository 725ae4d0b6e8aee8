import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cleanloom.functions import stats
from cleanloom.functions.stats import (
    adjusted_skewness, aggregate, clean_modes, distinct_counts, duplicate_rows, percentiles, value_counts)


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.lognormal(size=4000), np.full(2000, 1.25), rng.integers(0, 5, 1000), [-1e9, 1e12]])
    rng.shuffle(values)
    df = spark.createDataFrame([(float(v), None if i % 7 == 0 else float(v)) for i, v in enumerate(values)], "a double, b double")
    kept = np.array([v for i, v in enumerate(values) if i % 7])
    return df.repartition(8).cache(), values, kept


@pytest.mark.parametrize("in_memory", [1_000_000, 500, 20])
def test_percentiles_are_exact_at_any_memory_limit(numbers, in_memory):
    df, a, b = numbers
    points = [0.0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0]
    got = percentiles(df, {"a": (F.col("a"), points), "b": (F.col("b"), [0.5])}, in_memory=in_memory, accuracy=100)
    np.testing.assert_allclose(got["a"], np.quantile(a, points), rtol=1e-12)
    np.testing.assert_allclose(got["b"], np.quantile(b, [0.5]), rtol=1e-12)


def passes_of(monkeypatch):
    """The number of expressions of every pass over the data that ``stats`` takes from here on."""
    taken = []

    def counted(df, expressions, fuse_limit=stats.FUSE_LIMIT):
        names = list(expressions)
        taken.extend(len(names[i:i + fuse_limit]) for i in range(0, len(names), fuse_limit))
        return aggregate(df, expressions, fuse_limit)

    monkeypatch.setattr(stats, "aggregate", counted)
    return taken


def test_large_columns_take_three_passes(spark, monkeypatch):
    rng = np.random.default_rng(5)
    columns = [rng.normal(size=60_000), rng.lognormal(size=60_000), np.repeat(rng.normal(size=6), 10_000)]
    df = spark.createDataFrame([tuple(map(float, r)) + (float(i) if i < 300 else None,) for i, r in enumerate(zip(*columns))],
                               "a double, b double, c double, few double").repartition(8)
    monkeypatch.setattr(type(df), "count", lambda self: pytest.fail("a pass of its own to count rows"))
    taken, points = passes_of(monkeypatch), [0.01, 0.25, 0.5, 0.75, 0.99]
    got = percentiles(df, {c: (F.col(c), points) for c in df.columns}, in_memory=1500, accuracy=4000)
    assert len(taken) <= 3
    for name, values in zip("abc", columns):
        np.testing.assert_allclose(got[name], np.quantile(values, points), rtol=1e-12)
    np.testing.assert_allclose(got["few"], np.quantile(np.arange(300), points), rtol=1e-12)


def test_ranks_are_right_though_the_sketch_is_rough(spark, monkeypatch):
    values = np.random.default_rng(7).integers(-40, 40, 30_000).astype(float) ** 3
    df = spark.createDataFrame([(v,) for v in values.tolist()], "v double").repartition(6)
    points = [0, 0.003, 0.1, 0.5, 0.77, 1]
    for accuracy in (8, 50):
        got = percentiles(df, {"v": (F.col("v"), points)}, in_memory=10, accuracy=accuracy)
        np.testing.assert_allclose(got["v"], np.quantile(values, points), rtol=1e-12)


def test_nan_and_infinity_have_ranks(spark):
    values = [float(i) for i in range(1000)] + [float("inf")] * 200 + [float("nan")] * 800 + [float("-inf")] * 4
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(4)
    got = percentiles(df, {"v": (F.col("v"), [0.0, 0.25, 0.55, 0.9]), "nan": (F.when(F.isnan("v"), F.col("v")), [0.5])}, in_memory=20, accuracy=200)
    assert got["v"][:3] == [float("-inf"), 496.75, float("inf")] and np.isnan(got["v"][3]) and np.isnan(got["nan"][0])


def test_percentiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert percentiles(df, {"x": (F.col("x"), [0.1, 0.5])}) == {"x": [None, None]}
    assert percentiles(df, {}) == {}


def test_aggregate_in_batches(spark):
    df = spark.range(10)
    assert aggregate(df, {i: F.sum(F.col("id") + i) for i in range(7)}, fuse_limit=3) == {i: 45 + 10 * i for i in range(7)}


def test_adjusted_skewness(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double")
    assert round(df.agg(adjusted_skewness(F.col("x"))).first()[0], 4) == 1.7636


def test_duplicates_treat_nulls_and_borders_apart(spark):
    rows = [("a", None), ("a", None), (None, "a"), ("ab", "c"), ("a", "bc"), ("", None), (None, None)]
    got = duplicate_rows(spark.createDataFrame(rows, "x string, y string")).first()
    assert (got.rows, got.distinct_rows, got.duplicate_rows) == (7, 6, 1)


def test_duplicates_of_floats(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (float("nan"),), (float("nan"),), (None,)], "x double")
    assert duplicate_rows(df).first().duplicate_rows == df.count() - df.distinct().count() == 2


def test_counts_and_modes(spark):
    rows = [(random.choice("ab"), "x") for _ in range(50)] + [(None, "y"), ("c", None)]
    df = spark.createDataFrame(rows, "a string, b string")
    assert distinct_counts(df, {"a": F.col("a"), "b": F.col("b")}) == {"a": df.select("a").distinct().count() - 1, "b": 2}
    tie = spark.createDataFrame([("b",), ("a",), ("a",), ("b",), ("c",)], "v string")
    assert clean_modes(tie, {"v": F.col("v")})["v"] == {"column": "v", "mode": "a", "top": 2, "total": 5, "distinct": 3}
    assert value_counts(tie, {"v": F.col("v")}).count() == 3


def test_long_texts_are_counted_by_digest_and_shown_whole(spark):
    long = ["x" * 100 + str(i % 3) for i in range(9)] + ["short"] * 2
    df = spark.createDataFrame([(t,) for t in long], "t string")
    assert distinct_counts(df, {"t": F.col("t")}) == {"t": 4}
    assert max(len(r.value) for r in value_counts(df, {"t": F.col("t")}).collect()) < 101
    mode = clean_modes(df, {"t": F.col("t")})["t"]
    assert mode["top"] == 3 and mode["mode"] in long and len(mode["mode"]) == 101


def test_ties_of_long_texts_are_settled_whole(spark):
    from cleanloom.functions.stats import top_values

    texts = ["same beginning of them all " + c * 80 for c in "qzmbxa"] + ["w"]
    df = spark.createDataFrame([(t,) for t in texts for _ in range(2)], "t string")
    columns = {"t": F.col("t")}
    assert clean_modes(df, columns)["t"]["mode"] == min(texts)
    top = top_values(value_counts(df, columns), 3, whole=(df, columns)).orderBy("rank").collect()
    assert [r["value"] for r in top] == sorted(texts)[:3]
    smallest = value_counts(df, columns).withColumn("first_key", F.col("value"))
    first = top_values(smallest, 4, by_first=True, whole=(df, columns)).orderBy("rank").collect()
    assert [r["value"] for r in first] == sorted(texts)[:4]


def test_top_values_of_long_texts(spark):
    from cleanloom.operators.profile import profile

    df = spark.createDataFrame([("y" * 200,), ("y" * 200,), ("b",)], "t string")
    row = profile(df).first()
    assert row.top_values == [("y" * 200, 2), ("b", 1)] and set(row["sample"]) == {"b", "y" * 200} and row.distinct == 2


@pytest.mark.parametrize("common", [0, 5, 40, 700])
def test_long_texts_that_tie_are_chosen_by_few_rows(spark, monkeypatch, common):
    """Unique long texts, all with one beginning: the n smallest are shown, and no step holds more than the contenders of a column."""
    from cleanloom.functions import stats

    monkeypatch.setattr(stats, "CONTENDERS", 20)
    draw = random.Random(common)
    texts = ["\u00fc" * common + f"{draw.randrange(10**6):06d}" + "z" * 300 for _ in range(2000)]
    df = spark.createDataFrame([(t,) for t in texts + texts[:3] + [texts[5]]], "t string").repartition(4)
    columns, counts = {"t": F.col("t")}, stats.value_counts(df, {"t": F.col("t")})
    ranked = sorted({t: texts.count(t) + (texts + texts[:3] + [texts[5]]).count(t) - texts.count(t) for t in texts}.items(), key=lambda x: (-x[1], x[0]))
    assert stats._contenders(counts, 9, False, df, columns).count() <= 20 + 9
    top = stats.top_values(counts, 9, whole=(df, columns)).orderBy("rank").collect()
    assert [(r["value"], r["n"]) for r in top] == ranked[:9]
    first = stats.top_values(counts.withColumn("first_key", F.col("value")), 7, by_first=True, whole=(df, columns)).orderBy("rank").collect()
    assert [r["value"] for r in first] == sorted(set(texts))[:7]
    assert stats.clean_modes(df, columns)["t"]["mode"] == ranked[0][0]


def test_a_task_keeps_n_of_the_tied_values(spark):
    """The plan limits each task before rows of a column meet."""
    from cleanloom.functions import stats

    df = spark.range(5000).select(F.concat(F.lit("x" * 80), F.col("id").cast("string")).alias("t"))
    place = F.row_number().over(stats.Window.partitionBy("column").orderBy(F.col("n").desc(), F.left("value", F.lit(16))))
    plan = stats.value_counts(df, {"t": F.col("t")}).withColumn("place", place).filter("place <= 5")
    assert "WindowGroupLimit" in plan._jdf.queryExecution().executedPlan().toString()
