import pytest

from cleanloom.llm import mixing


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    """{source: target} by handing the excess on until nobody is above the limit."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), {}
    while True:
        left = [s for s in order if s not in full]
        if not left:
            return full
        rate = (total - sum(full.values())) / sum(weight[s] for s in left)
        above = [s for s in left if weight[s] * rate > most * sizes[s]]
        if not above:
            return full | {s: weight[s] * rate for s in left}
        full |= {s: most * sizes[s] for s in above}


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 1000, "c": 5}, {"a": 1, "b": 1, "c": 100, "d": 3, None: 50}, {"Z": 7, "a": 7, "é": 7, "\U0001F600": 7, "～": 7}, {"only": 9}, {"a": 0, "b": 4}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(rows).collect()}
    assert got == pytest.approx(plain_targets(sizes))


def test_copies_come_near_the_target(spark, make_docs):
    docs = make_docs(*[(i, "w " * (i % 97 + 1), None, f"s{min(i % 8, 4)}" if i % 9 else None) for i in range(3000)])
    rows = mixing.mixed(docs).collect()
    assert len(rows) == 3000 and all(0 <= r["copies"] <= 3 for r in rows)
    for source in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == source]
        assert sum(r["copies"] * r["size"] for r in own) == pytest.approx(own[0]["target"], rel=0.03)
        assert {r["copies"] for r in own} <= {int(own[0]["target"] // own[0]["source_size"]) + i for i in (0, 1)}
    spark.conf.set("spark.sql.shuffle.partitions", "40")  # the cells change, the mix does not
    try:
        again = mixing.mixed(docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_mix_repeats_rows_with_their_columns(spark, make_docs):
    docs = make_docs(*[(i, "w " * 9, "en", "big" if i else "a") for i in range(60)], (None, None, None, None), (60, "", "en", None), (5, "w " * 9, "en", "big"))
    docs = docs.withColumn("size", mixing.F.lit("clash")).withColumn("step", mixing.F.lit(1))
    plan = {(r["id"], r["source"]): r for r in mixing.mixed(docs).collect()}
    assert plan[(0, "a")]["copies"] == 3 and plan[(None, None)]["copies"] == 0 and plan[(None, None)]["size"] == 0
    mix = mixing.mix(docs)
    assert mix.columns == docs.columns
    assert mix.filter("doc_id = 0").count() == 3


def test_empty_table(spark, make_docs):
    assert mixing.mixed(make_docs()).count() == 0
    assert mixing.mix(make_docs()).count() == 0
