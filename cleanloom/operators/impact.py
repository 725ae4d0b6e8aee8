"""Completeness, quality score and the before/after report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanloom.functions.columns import kinds, missing, ref
from cleanloom.functions.stats import row_digest, spread


def _present(df: DataFrame) -> dict:
    kind = kinds(df)
    return {c: F.count(F.when(~missing(ref(c), kind[c]), F.lit(1))) for c in df.columns}


def cells(df: DataFrame) -> DataFrame:
    """One row: rows, columns, present cells, completeness percent (0 for an empty table)."""
    present = sum(_present(df).values(), F.lit(0))
    rows = F.count(F.lit(1))
    total = rows * F.lit(len(df.columns))
    return df.agg(
        rows.alias("rows"), F.lit(len(df.columns)).cast("long").alias("columns"), present.cast("long").alias("present"),
        (total - present).cast("long").alias("missing"),
        F.when(total > 0, present / total * 100).otherwise(F.lit(0.0)).alias("completeness"))


def column_completeness(df: DataFrame) -> DataFrame:
    """(column, completeness), from one aggregate over all columns."""
    rows = F.count(F.lit(1))
    shares = [F.struct(F.lit(c).alias("column"),
                       F.when(rows > 0, n / rows * 100).otherwise(F.lit(0.0)).alias("completeness"))
              for c, n in _present(df).items()]
    return df.agg(F.array(*shares).alias("s")).select(F.inline("s"))


def _quality(df: DataFrame) -> DataFrame:
    """One row with the table measures and, in ``shares``, the completeness of each column.

    One pass: rows with the same digest are counted together with the present cells of each column.
    """
    kind = kinds(df)
    held = [(~missing(ref(c), kind[c])).cast("int").alias(f"p{i}") for i, c in enumerate(df.columns)]
    groups = (spread(df).select(row_digest(df).alias("d"), *held).groupBy("d")
              .agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"p{i}").alias(f"p{i}") for i in range(len(held))]))
    rows, width = F.coalesce(F.sum("n"), F.lit(0)), F.lit(len(df.columns))
    present = [F.coalesce(F.sum(f"p{i}"), F.lit(0)) for i in range(len(held))]
    filled, total = sum(present, F.lit(0).cast("long")), rows * width
    shares = F.array(*[F.struct(F.lit(c).alias("column"), F.when(rows > 0, n / rows * 100).otherwise(F.lit(0.0)).alias("completeness"))
                       for c, n in zip(df.columns, present)])
    measured = groups.agg(
        rows.alias("rows"), width.cast("long").alias("columns"), filled.alias("present"), (total - filled).alias("missing"),
        F.when(total > 0, filled / total * 100).otherwise(F.lit(0.0)).alias("completeness"),
        (rows - F.count(F.lit(1))).alias("duplicate_rows"), shares.alias("shares"))
    penalty = F.when(F.col("rows") > 0, F.col("duplicate_rows") / F.col("rows") * 10).otherwise(F.lit(0.0))
    return measured.withColumn(
        "quality_score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("completeness") - penalty)))


def quality(df: DataFrame) -> DataFrame:
    """One row with all table measures and the score: completeness less 10 x the duplicate share, in 0..100."""
    return _quality(df).drop("shares")


def impact(before: DataFrame, after: DataFrame) -> DataFrame:
    """Long report (metric, column, before, after, delta); delta is after minus before. One pass over each side."""
    metrics = {"rows": "total_rows", "columns": "total_columns", "missing": "missing_values",
               "duplicate_rows": "duplicate_rows", "completeness": "completeness", "quality_score": "quality_score"}

    def long(df, side):
        table = F.array(*[F.struct(F.lit(label).alias("metric"), F.lit(None).cast("string").alias("column"), F.col(name).cast("double").alias(side))
                          for name, label in metrics.items()])
        columns = F.transform("shares", lambda s: F.struct(
            F.lit("column_completeness").alias("metric"), s["column"].alias("column"), s["completeness"].cast("double").alias(side)))
        return _quality(df).select(F.inline(F.concat(table, columns)))

    # Both sides hold one row per metric and column; null-safe on the column of table metrics.
    old, new = long(before, "before").alias("o"), long(after, "after").alias("n")
    joined = old.join(new, (F.col("o.metric") == F.col("n.metric"))
                      & F.col("o.column").eqNullSafe(F.col("n.column")), "full_outer")
    return joined.select(
        F.coalesce("o.metric", "n.metric").alias("metric"), F.coalesce("o.column", "n.column").alias("column"),
        "before", "after", (F.col("after") - F.col("before")).alias("delta"))
