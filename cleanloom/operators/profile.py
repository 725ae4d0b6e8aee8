"""Column profile: nulls, distinct values, samples, moments, date range, top values, text length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cleanloom.functions.columns import cell_text, is_numeric, kinds, missing, ref, to_real
from cleanloom.functions.stats import LONG_TEXT_BYTES, aggregate, count_if, long_columns, spread, top_values, value_counts

PROFILE_SCHEMA = ("column string, position int, dtype string, logical_type string, rows long, nulls long, "
                  "distinct long, mean double, std double, min double, max double, min_date timestamp, "
                  "max_date timestamp, avg_length double, sample array<string>, "
                  "top_values array<struct<value:string,n:bigint>>, source string, ingested_at timestamp")


def column_measures(df: DataFrame) -> dict:
    """Single-pass aggregates of every column, keyed by (column, measure)."""
    asked = {(None, "rows"): F.count(F.lit(1)), (None, "now"): F.max(F.current_timestamp())}
    for name, k in kinds(df).items():
        c = ref(name)
        asked[(name, "nulls")] = count_if(missing(c, k))
        if is_numeric(k) or k == "boolean":
            real = to_real(c, k)
            asked.update({(name, "mean"): F.avg(real), (name, "std"): F.stddev_samp(real),
                          (name, "min"): F.min(real), (name, "max"): F.max(real)})
        elif k == "temporal":
            asked.update({(name, "min_date"): F.min(c.cast("timestamp")), (name, "max_date"): F.max(c.cast("timestamp"))})
        elif k == "string":
            asked.update({(name, "avg_length"): F.avg(F.length(c)), (name, "bytes"): F.max(F.octet_length(c))})
    return aggregate(spread(df), asked)


def _texts(df: DataFrame, columns: list[str] | None = None) -> dict:
    kind = kinds(df)
    texts = {}
    for name in columns or df.columns:
        value = cell_text(ref(name), kind[name])
        if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):  # -0.0 is 0.0
            value = cell_text(ref(name) + F.lit(0.0).cast(df.schema[name].dataType), kind[name])
        texts[name] = F.when(ref(name).isNotNull(), F.when(value != "NaN", value) if kind[name] == "float" else value)
    return texts


def counted_values(df: DataFrame, order_by: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """(column, value, n[, first_key]) of all columns; the one shuffle behind distinct, sample and top values."""
    return value_counts(df, _texts(df, columns), [ref(k) for k in order_by] if order_by else None)


def profile(df: DataFrame, source: str | None = None, top_n: int = 5, order_by: list[str] | None = None,
            approximate_distinct: bool = False) -> DataFrame:
    """One row per column. Samples need ``order_by`` to mean the first values; else the smallest are shown.

    Two passes: the fused measures, and one counted-values shuffle that is reduced to at most
    ``top_n`` rows per column and rule before it reaches the driver.
    """
    spark, kind = df.sparkSession, kinds(df)
    logical = {f.name: f.metadata.get("logical_type") for f in df.schema.fields}
    measures = column_measures(df)
    key = order_by
    if approximate_distinct:
        distinct = aggregate(df, {c: F.approx_count_distinct(cell_text(ref(c), kind[c])) for c in df.columns})
        wanted = [c for c in df.columns if kind[c] in ("string", "other")]
        counts = counted_values(df, key, wanted) if wanted else None
    else:
        distinct, counts = None, counted_values(df, key)
    samples: dict[str, list] = {}
    tops: dict[str, list] = {}
    if counts is not None:
        first = F.col("first_key") if key else F.col("value")
        texts = _texts(df)
        whole = (df, {c: texts[c] for c, k in kind.items() if k in ("string", "other")})
        # Texts were measured above; only cells of other kinds still have to be.
        long = [c for c in whole[1] if kind[c] == "string" and (measures[(c, "bytes")] or 0) > LONG_TEXT_BYTES]
        other = {c: e for c, e in whole[1].items() if kind[c] == "other"}
        long += long_columns(df, other) if other else []
        # Every rule is a bounded aggregate over the counted values, merged into one small result.
        ranked = [
            top_values(counts.withColumn("first_key", first), top_n, by_first=True, whole=whole, long=long)
            .select("column", "value", "n", "rank", F.lit("sample").alias("rule")),
            top_values(counts, top_n, whole=whole, long=long).select("column", "value", "n", "rank", F.lit("top").alias("rule")),
        ]
        if distinct is None:
            # Also reading n keeps the counted values the same in all rules, so they are shuffled once.
            ranked.append(counts.groupBy("column").agg(F.count(F.lit(1)).alias("d"), F.sum("n").alias("n")).select(
                "column", F.col("n").cast("string").alias("value"), F.col("d").alias("n"), F.lit(1).alias("rank"),
                F.lit("distinct").alias("rule")))
            distinct = dict.fromkeys(df.columns, 0)
        small = ranked[0]
        for part in ranked[1:]:
            small = small.unionByName(part)
        picked = sorted(small.collect(), key=lambda r: r["rank"])
        for r in picked:
            value = r["value"]
            if r["rule"] == "sample":
                samples.setdefault(r["column"], []).append(value)
            elif r["rule"] == "top":
                tops.setdefault(r["column"], []).append((value, r["n"]))
            else:
                distinct[r["column"]] = r["n"]
    rows = []
    for i, (name, k) in enumerate(kind.items()):
        m = {measure: v for (c, measure), v in measures.items() if c == name}
        text = k in ("string", "other")
        rows.append((
            name, i, dict(df.dtypes)[name], logical[name], measures[(None, "rows")], m["nulls"], distinct[name],
            m.get("mean"), m.get("std"), m.get("min"), m.get("max"), m.get("min_date"), m.get("max_date"),
            None if logical[name] == "categorical" else m.get("avg_length"),
            samples.get(name, []), tops.get(name, []) if text else None, source, measures[(None, "now")]))
    return spark.createDataFrame(rows, PROFILE_SCHEMA)
