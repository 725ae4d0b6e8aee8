"""Multivariate outliers: isolation forest or local outlier factor, marked +1 (inlier) or -1."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanloom.functions.columns import is_numeric, kinds, ref, to_real
from cleanloom.functions.stats import aggregate, count_if, percentiles, spread
from cleanloom.operators.isolation import Forest, fit_forest, score_column
from cleanloom.operators.lof import NEIGHBOURS, Density, fit_density, new_scores, row_scores, training_scores
from cleanloom.session import scratch_path

MARK = "Outlier"
METHODS = ("isolation_forest", "lof")
MIN_FEATURES = 2


@dataclass(frozen=True)
class Model:
    method: str
    features: tuple[str, ...]
    contamination: float
    threshold: float
    fitted: Forest | Density
    novelty: bool = True


class NotFitted(RuntimeError):
    """Detection without a fitted model."""


def numeric_features(df: DataFrame, features: list[str] | None = None) -> list[str]:
    found = [c for c, k in kinds(df).items() if is_numeric(k) and c != MARK]
    chosen = [c for c in features if c in found] if features is not None else found
    if not chosen:
        raise ValueError("no numeric columns for outlier detection")
    return chosen


def _filled(df: DataFrame, features) -> dict:
    """Features as complete doubles; medians are taken only of columns with missing values."""
    kind = kinds(df)
    real = {c: to_real(ref(c), kind[c]) for c in features}
    missing = aggregate(df, {c: count_if(real[c].isNull()) for c in features})
    middle = percentiles(df, {c: (real[c], [0.5]) for c in features if missing[c]})
    return {c: F.coalesce(real[c], F.lit(middle[c][0] if middle[c][0] is not None else 0.0)) if missing[c] else real[c]
            for c in features}


def prepare(df: DataFrame, features: list[str], keep: list[str] | None = None) -> DataFrame:
    """Features as doubles with missing values replaced by the column median (0 for empty columns)."""
    filled = _filled(df, features)
    keep = [c for c in keep or df.columns if c not in features]
    return df.select(*[ref(c) for c in keep], *[filled[c].alias(c) for c in features])


def _vector(features) -> F.Column:
    return F.array(*[ref(c) + F.lit(0.0) for c in features])


def fit(df: DataFrame, key: list[str] | None = None, method: str = "isolation_forest", contamination: float = 0.05,
        seed: int = 42, features: list[str] | None = None, novelty: bool = True, neighbours: int = NEIGHBOURS,
        pivots: int | None = None, search: str = "exact") -> Model:
    """Fit on the numeric columns. The forest needs ``key``, unique columns that identify a row.

    ``search`` is how the local factor finds neighbours: ``exact``, or ``projections`` for large tables of many columns.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}")
    names = numeric_features(df, features)
    if method == "isolation_forest":
        if not key:
            raise ValueError("the isolation forest samples rows by a unique key: pass key")
        rows = df.count()
        # Key columns that are features too are kept under their own names for sampling.
        keyed = df.select(*df.columns, *[ref(k).alias(f"__key{i}") for i, k in enumerate(key)])
        ready = prepare(keyed, names)
        forest = fit_forest(ready, names, [f"__key{i}" for i in range(len(key))], rows, seed)
        scores = _stored(spread(ready).select(score_column(forest, [ref(c) for c in names]).alias("score")))
        cut = percentiles(scores, {"t": (F.col("score"), [contamination])})["t"][0]
        return Model(method, tuple(names), contamination, cut, forest)
    ready = prepare(df, names)
    k = min(neighbours, max(ready.count() - 1, 1))
    density = fit_density(ready.select(_vector(names).alias("x")), k, pivots, seed, search)
    # The threshold is over rows, so each row takes the score of its vector; only scores are expanded, never vectors.
    rows = _stored(row_scores(density, df.sparkSession))
    cut = percentiles(rows, {"t": (F.col("score"), [contamination])})["t"][0]
    return Model(method, tuple(names), contamination, cut, density, novelty)


def _stored(scores: DataFrame) -> DataFrame:
    """Scores on shared storage: the exact threshold takes several passes over them."""
    path = scratch_path(scores.sparkSession, "scores")
    scores.write.parquet(path)
    return scores.sparkSession.read.parquet(path)


def detect(df: DataFrame, model: Model | None, key: list[str] | None = None) -> DataFrame:
    """Add ``Outlier``: -1 for outliers, +1 for all others (and for all rows of too narrow tables)."""
    if model is None:
        raise NotFitted("fit a model first")
    present = [c for c in model.features if c in df.columns]
    if len(present) < MIN_FEATURES:
        warnings.warn("fewer than two feature columns: no outliers marked", stacklevel=2)
        return df.withColumn(MARK, F.lit(1))
    if len(present) < len(model.features):
        raise ValueError(f"columns of the fitted model are missing: {sorted(set(model.features) - set(present))}")
    filled = list(_filled(df, present).values())
    mark = F.when(F.col("__score") < F.lit(model.threshold), F.lit(-1)).otherwise(F.lit(1))
    if model.method == "isolation_forest":
        scored = spread(df).withColumn("__score", score_column(model.fitted, filled))
    else:
        keyed = df.withColumn("__x", F.array(*[f + F.lit(0.0) for f in filled]))
        scores = (new_scores(keyed.select(F.col("__x").alias("x")), model.fitted) if model.novelty
                  else training_scores(model.fitted, df.sparkSession).select("x", "score"))
        # One score per distinct vector; a hot vector is split by the adaptive skew join.
        scored = keyed.join(scores.select(F.col("x").alias("__x"), F.col("score").alias("__score")), "__x", "left")
    return scored.withColumn(MARK, mark).drop("__score", "__x")


def inliers(marked: DataFrame) -> DataFrame:
    return marked.filter(F.col(MARK) == 1).drop(MARK)


def summary(marked: DataFrame) -> DataFrame:
    """One row: total, outliers, percent."""
    hit = count_if(F.col(MARK) == -1)
    total = F.count(F.lit(1))
    return marked.agg(total.alias("total"), hit.alias("outliers"),
                      F.when(total > 0, hit * 100.0 / total).otherwise(F.lit(0.0)).alias("percent"))
