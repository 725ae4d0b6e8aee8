"""Mergeable column summaries: a profile of a growing folder that reads each file once.

A summary holds one row per batch (a file, or any group of rows) and column: counts, moments, extremes, and two sketches, one of the
distinct values and one of the ranks of numbers. Summaries of several batches merge into the profile of all their rows; what was
summarised is not read again. Counts, extremes, means and deviations are those of the whole; ``distinct`` is off by less than about
``DISTINCT_ERROR`` and a quantile stands at a rank off by less than about ``RANK_ERROR`` (both as shares; three standard errors).

Defined cases: nulls and NaN count as missing; a column without values has null measures and zero distinct values; a batch without
rows leaves no summary; a batch that lacks a column adds nothing to it; an empty summary gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cleanloom.functions.columns import cell_text, is_numeric, kinds, missing, ref, to_real

DISTINCT_BITS = 14
DISTINCT_ERROR = 0.025
RANK_SIZE = 2000
RANK_ERROR = 0.004
QUARTILES = (0.25, 0.5, 0.75)

SUMMARY_SCHEMA = ("batch string, column string, position int, dtype string, rows long, nulls long, n long, mean double, m2 double, min double, "
                  "max double, min_date timestamp, max_date timestamp, texts long, length long, distinct binary, ranks binary")


def summarize(df: DataFrame, batch: Column) -> DataFrame:
    """The summaries of all batches in one pass; ``batch`` tells them apart, such as ``F.input_file_name()``."""
    none = {"double": F.lit(None).cast("double"), "timestamp": F.lit(None).cast("timestamp"), "long": F.lit(0).cast("long")}
    columns = []
    for i, (name, k) in enumerate(kinds(df).items()):
        c, types = ref(name), dict(df.dtypes)
        held = F.when(~missing(c, k), c)
        number = F.when(held.isNotNull(), to_real(c, k)) if is_numeric(k) or k == "boolean" else None
        if number is not None:
            number = number + F.lit(0.0)  # -0.0 is 0.0
        text = F.concat(F.lit("="), cell_text(held, k) if number is None else number.cast("string"))  # the sketch passes over empty texts
        part = {
            "column": F.lit(name), "position": F.lit(i), "dtype": F.lit(types[name]), "rows": F.count(F.lit(1)),
            "nulls": F.count(F.when(missing(c, k), 1)), "n": none["long"], "mean": none["double"], "m2": none["double"], "min": none["double"],
            "max": none["double"], "min_date": none["timestamp"], "max_date": none["timestamp"], "texts": none["long"], "length": none["long"],
            "distinct": F.hll_sketch_agg(text, F.lit(DISTINCT_BITS)), "ranks": F.lit(None).cast("binary")}
        if number is not None:
            part |= {"n": F.count(number), "mean": F.avg(number), "m2": F.var_pop(number) * F.count(number), "min": F.min(number),
                     "max": F.max(number), "ranks": F.kll_sketch_agg_double(number, F.lit(RANK_SIZE))}
        elif k == "temporal":
            part |= {"min_date": F.min(held.cast("timestamp")), "max_date": F.max(held.cast("timestamp"))}
        elif k == "string":
            part |= {"texts": F.count(held), "length": F.coalesce(F.sum(F.length(held)), F.lit(0)).cast("long")}
        columns.append(F.struct(*[e.alias(f) for f, e in part.items()]))
    spread = df.withColumn("__batch", batch).groupBy("__batch").agg(F.array(*columns).alias("__columns"))
    return spread.select(F.col("__batch").alias("batch"), F.inline("__columns"))


def merge(summaries: DataFrame) -> DataFrame:
    """One summary per column, as if of a single batch."""
    # A batch lies away from the common mean by the square of their difference, for each of its values.
    of_column = Window.partitionBy("column")
    common = F.sum(F.col("mean") * F.col("n")).over(of_column) / F.nullif(F.sum("n").over(of_column), F.lit(0))
    away = F.col("m2") + F.col("n") * (F.col("mean") - F.col("__mean")) * (F.col("mean") - F.col("__mean"))
    return summaries.withColumn("__mean", common).groupBy("column").agg(
        F.lit("all").alias("batch"), F.min("position").alias("position"), F.max_by("dtype", "batch").alias("dtype"),
        *[F.sum(c).alias(c) for c in ("rows", "nulls", "n", "texts", "length")],
        F.max("__mean").alias("mean"), F.sum(away).alias("m2"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.min("min_date").alias("min_date"), F.max("max_date").alias("max_date"),
        F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("ranks").alias("ranks"),
    ).select(*[c.split()[0] for c in SUMMARY_SCHEMA.split(", ")])


def described(summaries: DataFrame) -> DataFrame:
    """The profile of all rows behind the summaries, one row per column."""
    places = F.array(*[F.lit(p) for p in QUARTILES])
    return merge(summaries).select(
        "column", "position", "dtype", "rows", "nulls", F.hll_sketch_estimate("distinct").alias("distinct"), "mean",
        F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1))).alias("std"), "min", "max", "min_date", "max_date",
        F.when(F.col("texts") > 0, F.col("length") / F.col("texts")).alias("avg_length"),
        F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("ranks", places)).alias("quartiles"))


def refresh(spark: SparkSession, data: str, summaries: str) -> DataFrame:
    """Summarise the Parquet files of folder ``data`` that the table ``summaries`` does not know yet, and return the whole table.

    Known files are not opened but for the schema. Their names are compared on the driver, as a listing is. A file must not change once
    it is summarised; one that vanished keeps its summary.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(summaries)
    found = spark.read.parquet(data)
    known: set[str] = set()
    if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        known = {r.batch for r in spark.read.schema(SUMMARY_SCHEMA).parquet(summaries).select("batch").distinct().collect()}
    new = [f for f in found.inputFiles() if f not in known]
    if new:
        rows = spark.read.schema(found.schema).parquet(*new)
        part = summarize(rows, F.input_file_name())
        part.write.mode("append").parquet(summaries)
    return spark.read.schema(SUMMARY_SCHEMA).parquet(summaries)
