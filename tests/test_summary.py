import numpy as np
import pytest
from pyspark.sql import functions as F

from cleanloom.operators import profile, summary


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(11)
    data = [(i, float(x), None if i % 7 == 0 else float("nan") if i % 7 == 1 else 1e6 + float(y), f"t{i % 900}" if i % 5 else None, bool(i % 2))
            for i, (x, y) in enumerate(zip(rng.lognormal(size=6000), rng.normal(size=6000)))]
    return spark.createDataFrame(data, "k int, x double, far double, t string, b boolean").withColumn(
        "day", F.expr("date_add(DATE'2024-01-01', k % 100)")).withColumn("nothing", F.lit(None).cast("double"))


def check(found, whole):
    whole = {r.column: r for r in whole.collect()}
    found = {r.column: r for r in found.collect()}
    assert set(found) == set(whole)
    for c, r in found.items():
        w = whole[c]
        assert (r.rows, r.nulls, r.min, r.max, r.min_date, r.max_date) == (w.rows, w.nulls, w.min, w.max, w.min_date, w.max_date), c
        assert abs(r.distinct - w.distinct) <= summary.DISTINCT_ERROR * w.distinct, c
        for a, b in ((r.mean, w.mean), (r.std, w.std), (r.avg_length, w.avg_length if w.dtype == "string" else None)):
            assert (a is None and b is None) or a == pytest.approx(b, rel=1e-9), c
    return found


@pytest.mark.parametrize("batches", [1, 3, 150])
def test_merged_batches_equal_the_whole(rows, batches):
    states = summary.summarize(rows, F.col("k") % batches)
    found = check(summary.described(states), profile.profile(rows))
    x = np.sort([r.x for r in rows.select("x").collect()])
    for p, q in zip(summary.QUARTILES, found["x"].quartiles):
        assert abs(np.searchsorted(x, q) / len(x) - p) <= summary.RANK_ERROR
    assert found["nothing"].quartiles is None and found["nothing"].distinct == 0 and found["t"].quartiles is None


def test_known_files_are_not_read_again(spark, rows, tmp_path, monkeypatch):
    data, states = str(tmp_path / "data"), str(tmp_path / "states")
    asked = []
    monkeypatch.setattr(summary, "summarize", lambda df, batch, whole=summary.summarize: (asked.append(set(df.inputFiles())), whole(df, batch))[1])
    rows.filter("k < 4000").repartition(3).write.parquet(data)
    summary.refresh(spark, data, states)
    old = set(spark.read.parquet(data).inputFiles())
    rows.filter("k >= 4000").repartition(2).write.mode("append").parquet(data)
    both = summary.refresh(spark, data, states)
    assert asked[0] == old and not asked[1] & old and len(asked[1]) == 2
    check(summary.described(both), profile.profile(rows))
    summary.refresh(spark, data, states)
    assert len(asked) == 2  # nothing new


def test_empty(spark, rows):
    nothing = summary.summarize(rows.limit(0), F.lit("a"))
    assert nothing.count() == 0 and summary.described(nothing).count() == 0


def test_columns_may_be_missing_and_names_may_hold_dots(spark):
    a = summary.summarize(spark.createDataFrame([(1, "x")], "`a.b` int, batch string"), F.lit("1"))
    b = summary.summarize(spark.createDataFrame([("y",), (None,), ("",)], "batch string"), F.lit("2"))
    found = {r.column: (r.rows, r.nulls, r.distinct) for r in summary.described(a.unionByName(b)).collect()}
    assert found == {"a.b": (1, 0, 1), "batch": (4, 1, 3)}
