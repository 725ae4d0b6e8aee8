import math

import numpy as np
import pytest

from cleanloom.llm import ann

ROW = "vec_id long, embedding array<float>, label int, v string, shard int"


def plain_nearest(rows, k=20, step=20):
    """{query: [(id, score)]} over all usable rows."""
    good = {r[0]: np.array(r[1], np.float32).astype(np.float64) for r in rows}
    out = {}
    for q in (i for i in good if i % step == 0):
        scored = sorted(((-float((good[q] * v).sum()), i) for i, v in good.items() if i != q))[:k]
        out[q] = [(i, -s) for s, i in scored]
    return out


def clustered(n, dim=24, seed=8, scale=None):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(12, dim))
    v = centres[draw.integers(0, 12, n)] + 0.6 * draw.normal(size=(n, dim))
    return v * (draw.uniform(0.2, 3, (n, 1)) if scale else 1) / (1 if scale else np.linalg.norm(v, axis=1, keepdims=True))


@pytest.mark.parametrize("scale", [None, True])
def test_recall_and_scores(spark, scale):
    """Also where lengths differ, so that the largest product is not the smallest angle."""
    rows = [(i, [float(x) for x in v], 0, "clash", 7) for i, v in enumerate(clustered(2500, scale=scale))]
    found = {}
    for r in ann.nearest(spark.createDataFrame(rows, ROW), shard_vectors=600, block=40).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    exact = plain_nearest(rows)
    assert set(found) == set(exact)
    hits = 0
    for q, best in exact.items():
        mine = sorted(found[q])
        assert [r for r, _, _ in mine] == list(range(1, 21))
        assert [(-s, i) for _, i, s in mine] == sorted((-s, i) for _, i, s in mine)
        hits += len({i for i, _ in best} & {i for _, i, _ in mine})
        scores = {i: s for i, s in best}
        assert all(s == pytest.approx(scores[i], abs=1e-12) for _, i, s in mine if i in scores)
    assert hits / (20 * len(exact)) >= 0.95


def test_many_equal_vectors(spark):
    """A third of all rows is one vector: its smallest identifiers come back, and the others are still found."""
    rows = [(i, [1.0, 0.0, 0.0], 0, "", 0) for i in range(300)] + [(i, [0.6, 0.8 * math.cos(i), 0.8 * math.sin(i)], 0, "", 0) for i in range(300, 900)]
    found = {}
    for r in ann.nearest(spark.createDataFrame(rows, ROW), shard_vectors=200).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert [i for _, i in sorted(found[40])] == list(range(20))
    assert [i for _, i in sorted(found[0])] == list(range(1, 21))
    exact = plain_nearest(rows)
    share = np.mean([len({i for i, _ in exact[q]} & {i for _, i in found[q]}) / 20 for q in exact if q >= 300])
    assert share >= 0.9


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 0, "", 0), (1, [0.5, 0.5], 0, "", 0), (2, None, 0, "", 0), (3, [0.0, 0.0], 0, "", 0), (4, [nan, 1.0], 0, "", 0), (5, [inf, 1.0], 0, "", 0),
            (6, [None, 1.0], 0, "", 0), (7, [1.0], 0, "", 0), (8, [], 0, "", 0), (None, [1.0, 1.0], 0, "", 0), (20, [0.0, 0.0], 0, "", 0), (40, [-1.0, 0.0], 0, "", 0),
            (1, [0.5, 0.5], 0, "", 0), (9, [0.5, -0.5], 0, "", 0)]
    found = sorted(tuple(r) for r in ann.nearest(spark.createDataFrame(rows, ROW)).collect())
    assert found == [(0, 1, 1, 0.5), (0, 2, 9, 0.5), (0, 3, 40, -1.0), (40, 1, 1, -0.5), (40, 2, 9, -0.5), (40, 3, 0, -1.0)]


def test_empty_table(spark):
    assert ann.nearest(spark.createDataFrame([], ROW)).count() == 0
    assert ann.nearest(spark.createDataFrame([(0, [1.0, 2.0], 0, "", 0)], ROW)).count() == 0
