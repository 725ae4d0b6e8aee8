"""Row-order operators without a single-partition sort.

A frame has no row order, so every function takes ``order_by``: columns that together are unique and
never null. Rows fall into value ranges whose edges are literals taken from a bounded hash sample of
the keys, so retried tasks agree on them. Each range is sorted on its own; what must cross a range
border (a count, or the last known value) comes from one small aggregate row per range.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cleanloom.functions.columns import ref

ROWS_PER_RANGE = 1_000_000
MIN_ROWS_PER_RANGE = 2_000
MAX_RANGES = 8192
SAMPLES_PER_RANGE = 24
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"}
_BUCKET = "__range"


@dataclass(frozen=True)
class Ranges:
    """Bucket expression of a key, and the number of buckets."""

    bucket: Column
    count: int


def checked_rows(df: DataFrame, order_by: list[str]) -> int:
    """The number of rows, after a test that the key is unique and never null; only group counts are shuffled."""
    keys = [ref(name) for name in order_by]
    blank = F.greatest(*[k.isNull().cast("int") for k in keys], F.lit(0))
    found = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max(blank).alias("blank")).agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.max("blank")).first()
    if found[2]:
        raise ValueError(f"the key {order_by} holds nulls")
    if found[0] != found[1]:
        raise ValueError(f"the key {order_by} is not unique: {found[0]} rows, {found[1]} keys")
    return found[0]


def _key(order_by: list[str]) -> Column:
    return F.struct(*[ref(name).alias(f"k{i}") for i, name in enumerate(order_by)])


def key_ranges(df: DataFrame, order_by: list[str], rows: int, ranges: int | None = None) -> Ranges:
    """Split the key space into ranges of about equal row counts."""
    if not order_by:
        raise ValueError("order_by must name a unique, non-null key")
    cores = df.sparkSession.sparkContext.defaultParallelism
    wanted = ranges or min(MAX_RANGES, max(math.ceil(rows / ROWS_PER_RANGE), min(cores, rows // MIN_ROWS_PER_RANGE)))
    if wanted <= 1 or rows == 0:
        return Ranges(F.lit(0), 1)
    # Keep about SAMPLES_PER_RANGE keys per range, by key hash: the same rows on every run.
    modulus = max(1, rows // (wanted * SAMPLES_PER_RANGE))
    key = _key(order_by)
    sample = (df.filter(F.pmod(F.xxhash64(*[ref(k) for k in order_by]), F.lit(modulus)) == 0)
              .select(key.alias("k")).orderBy("k").select(F.to_json("k", _JSON).alias("j")))
    keys = [row["j"] for row in sample.collect()]
    step = len(keys) / wanted
    edges = [keys[int(i * step)] for i in range(1, wanted) if int(i * step) < len(keys)]
    if not edges:
        return Ranges(F.lit(0), 1)
    schema = T.ArrayType(T.StructType(
        [T.StructField(f"k{i}", df.schema[name].dataType) for i, name in enumerate(order_by)]))
    literal = F.from_json(F.lit("[" + ",".join(edges) + "]"), schema, _JSON)
    # Binary search: the number of edges at or below the key.
    steps = [1 << b for b in reversed(range(len(edges).bit_length()))]
    bucket = F.aggregate(
        F.array(*[F.lit(s) for s in steps]), F.lit(0),
        lambda at, jump: F.when(F.get(literal, at + jump - 1) <= key, at + jump).otherwise(at))
    return Ranges(bucket, len(edges) + 1)


def _offsets(values: list, schema: str) -> Column:
    """Per-range literals, looked up by the range number."""
    return F.get(F.from_json(F.lit("[" + ",".join(values) + "]"), schema, _JSON), F.col(_BUCKET))


def dense_numbers(df: DataFrame, order_by: list[str], name: str, start: int = 1, where: Column | None = None,
                  ranges: int | None = None) -> DataFrame:
    """Add consecutive numbers in key order; with ``where`` only those rows are counted."""
    counted = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    rows = checked_rows(df, order_by)
    split = key_ranges(df, order_by, rows, ranges)
    bucketed = df.withColumn(_BUCKET, split.bucket)
    per_range = {r[_BUCKET]: r["n"] for r in bucketed.groupBy(_BUCKET).agg(
        F.count(F.when(counted, F.lit(1))).alias("n")).collect()}
    totals, running = [], start - 1
    for i in range(split.count):
        totals.append(str(running))
        running += per_range.get(i, 0)
    window = (Window.partitionBy(_BUCKET).orderBy(*[ref(k) for k in order_by])
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    number = _offsets(totals, "array<bigint>") + F.count(F.when(counted, F.lit(1))).over(window)
    return bucketed.withColumn(name, F.when(counted, number)).drop(_BUCKET)


def forward_fill(df: DataFrame, column: str, order_by: list[str], ranges: int | None = None) -> DataFrame:
    """Replace nulls by the last known value in key order."""
    rows = checked_rows(df, order_by)
    split = key_ranges(df, order_by, rows, ranges)
    bucketed = df.withColumn(_BUCKET, split.bucket)
    known = F.when(ref(column).isNotNull(), _key(order_by))
    last = F.max_by(F.struct(ref(column).alias("v")), known)
    per_range = {r[_BUCKET]: r["j"] for r in bucketed.groupBy(_BUCKET).agg(
        F.to_json(last, _JSON).alias("j")).collect()}
    carry, held = [], "{}"
    for i in range(split.count):
        carry.append(held)
        held = per_range.get(i) or held
    value_type = T.ArrayType(T.StructType([T.StructField("v", df.schema[column].dataType)]))
    carried = F.get(F.from_json(F.lit("[" + ",".join(carry) + "]"), value_type, _JSON), F.col(_BUCKET))["v"]
    window = (Window.partitionBy(_BUCKET).orderBy(*[ref(k) for k in order_by])
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    filled = F.coalesce(F.last(ref(column), ignorenulls=True).over(window), carried)
    return (bucketed.withColumn("__filled", filled)
            .select(*[F.col("__filled").alias(c) if c == column else ref(c) for c in df.columns]))


def stochastic_fill(df: DataFrame, column: str, key: list[str], seed: int = 42,
                    buckets: int | None = None) -> DataFrame:
    """Replace nulls by known values of the column drawn at random, the same way on every run.

    The draw of a row is a hash of its unique key, reduced to one of the known values. Known values
    are numbered inside hash buckets, so neither numbering nor drawing sorts or gathers the table.
    """
    held = df.agg(F.count(ref(column)).alias("n"), F.count(F.lit(1)).alias("rows")).first()
    if held["n"] == 0 or held["n"] == held["rows"]:
        return df
    buckets = buckets or max(1, min(MAX_RANGES, math.ceil(held["n"] / ROWS_PER_RANGE)))
    keys = [ref(k) for k in key]
    place = F.pmod(F.xxhash64(*keys, F.lit("donor")), F.lit(buckets)).cast("int")
    donors = df.filter(ref(column).isNotNull()).select(
        ref(column).alias("__value"), F.struct(*keys).alias("__k"), place.alias(_BUCKET))
    sizes = {r[_BUCKET]: r["count"] for r in donors.groupBy(_BUCKET).count().collect()}
    totals, running = [], 0
    for i in range(buckets):
        totals.append(str(running))
        running += sizes.get(i, 0)
    window = Window.partitionBy(_BUCKET).orderBy("__k")
    numbered = donors.select(
        "__value", (_offsets(totals, "array<bigint>") + F.row_number().over(window) - 1).alias("__number"))
    draw = F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(held["n"])).cast("long")
    # Only the rows that need a value take part in the join; the others pass through unshuffled.
    missing = df.filter(ref(column).isNull()).withColumn("__number", draw)
    drawn = missing.join(numbered, "__number").select(
        *[F.col("__value").alias(c) if c == column else ref(c) for c in df.columns])
    return df.filter(ref(column).isNotNull()).unionByName(drawn)
