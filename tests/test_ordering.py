import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cleanloom.functions.ordering import dense_numbers, forward_fill, key_ranges, stochastic_fill

from physical import single_partition_exchanges


@pytest.fixture(scope="module")
def table(spark):
    """A hot first key column: the second one makes it unique."""
    return spark.range(10_000).selectExpr(
        "timestamp_micros(case when id % 3 = 0 then 0 else (id * 7919) % 1000 end * 1000001) as ts", "cast(id as string) as k",
        "case when id % 4 = 0 or id < 40 then id * 0.5 end as v").repartition(8).cache()


def rows(df, *columns):
    return [tuple(r) for r in df.select("ts", "k", *columns).orderBy("ts", "k").collect()]


@pytest.mark.parametrize("ranges", [1, 4, 37])
def test_forward_fill_equals_the_global_window(table, ranges):
    whole = Window.orderBy("ts", "k").rowsBetween(Window.unboundedPreceding, 0)
    expected = table.withColumn("v", F.last("v", ignorenulls=True).over(whole))
    got = forward_fill(table, "v", ["ts", "k"], ranges)
    assert rows(got, "v") == rows(expected, "v")
    assert ranges == 1 or single_partition_exchanges(got) == 0
    assert got.columns == table.columns


@pytest.mark.parametrize("ranges", [1, 4, 37])
def test_dense_numbers_equal_the_global_window(table, ranges):
    expected = table.withColumn("n", F.row_number().over(Window.orderBy("ts", "k")))
    got = dense_numbers(table, ["ts", "k"], "n", ranges=ranges)
    assert rows(got, "n") == rows(expected, "n")
    assert ranges == 1 or single_partition_exchanges(got) == 0


def test_numbers_of_chosen_rows(table):
    got = dense_numbers(table, ["ts", "k"], "n", where=F.col("v").isNotNull(), ranges=5)
    chosen = sorted(r.n for r in got.filter("v is not null").collect())
    assert chosen == list(range(1, len(chosen) + 1)) and got.filter("v is null and n is not null").count() == 0


def test_ranges_are_even_despite_a_hot_key(table):
    split = key_ranges(table, ["ts", "k"], 10_000, 10)
    sizes = [r["count"] for r in table.groupBy(split.bucket.alias("b")).count().collect()]
    assert split.count == 10 and len(sizes) == 10 and max(sizes) < 2500


def test_fill_of_text_and_dates(spark):
    df = spark.createDataFrame([(1, "a, \"x\""), (2, None), (3, None)], "k int, c string")
    assert [r.c for r in forward_fill(df, "c", ["k"], 3).orderBy("k").collect()] == ['a, "x"'] * 3
    days = df.selectExpr("k", "case when k = 1 then timestamp'2024-01-02 03:04:05.678901' end as c")
    assert {str(r.c) for r in forward_fill(days, "c", ["k"], 3).collect()} == {"2024-01-02 03:04:05.678901"}
    with pytest.raises(ValueError):
        forward_fill(df, "c", [])


def test_stochastic_fill_is_stable_and_whole(table):
    first = rows(stochastic_fill(table, "v", ["k"], seed=1, buckets=3), "v")
    assert first == rows(stochastic_fill(table.repartition(3), "v", ["k"], seed=1, buckets=3), "v")
    assert first != rows(stochastic_fill(table, "v", ["k"], seed=2, buckets=3), "v")
    known = {r.v for r in table.filter("v is not null").collect()}
    assert len(first) == 10_000 and {v for _, _, v in first} <= known
    before = {k: v for _, k, v in rows(table, "v") if v is not None}
    assert all(v == before.get(k, v) for _, k, v in first)
    drawn = [v for _, k, v in first if k not in before]
    assert len(set(drawn)) > 1500  # spread over the known values


def test_stochastic_fill_without_known_values(spark):
    df = spark.createDataFrame([(1, None)], "k int, c double")
    assert stochastic_fill(df, "c", ["k"]).first().c is None
