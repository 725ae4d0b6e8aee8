"""Fused aggregates, exact distributed percentiles, distinct counts and modes.

Every function here returns a result whose size depends on the number of columns, never on rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cleanloom.session import scratch_path

# More expressions than this go into a further pass: one generated aggregate stays compilable.
FUSE_LIMIT = 300
# Up to this many values the built-in exact percentile (a value -> count map) is safe in one task.
IN_MEMORY_VALUES = 1_000_000
# Up to this many values of all columns together are held by one such pass.
PASS_VALUES = 4_000_000
# Inputs above this estimated size are split well enough by the scan.
SPREAD_BYTES = 512 << 20
# Longer texts are grouped by a digest, so that counting documents does not shuffle them. The digest never decides an
# order: where it could, the few texts in question are compared whole.
LONG_TEXT_BYTES = 64
PREFIX = 16
DIGEST_MARK = "\u0000sha256:"
# Where longer beginnings are compared, they grow by this factor.
DEEPER = 16
# Up to this many texts of a column are compared whole to settle a tie.
CONTENDERS = 1000
# Size parameter of the sketch that brackets a percentile on larger data, and the places read off it.
SKETCH_ACCURACY = 10_000
GRID = 1000
# An input estimated at more bytes than this for each value that fits in memory is sketched in the pass that counts it.
BYTES_PER_VALUE = 64


def aggregate(df: DataFrame, expressions: dict, fuse_limit: int = FUSE_LIMIT) -> dict:
    """Evaluate many named global aggregates in as few passes as possible."""
    names = list(expressions)
    values: dict = {}
    for start in range(0, len(names), fuse_limit):
        part = names[start:start + fuse_limit]
        row = df.agg(*[expressions[name].alias(f"a{i}") for i, name in enumerate(part)]).first()
        values.update(zip(part, row))
    return values


def spread(df: DataFrame) -> DataFrame:
    """Spread a small input that arrives in a file or two before a pass that is heavy on CPU.

    One small file is one split and would keep one core busy. The decision rests on file sizes alone,
    and inputs above a fixed size are never shuffled for it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if estimated_bytes(df) > SPREAD_BYTES or not 0 < len(df.inputFiles()) * 4 <= cores:
        return df
    return df.repartition(cores)


def count_if(predicate: Column) -> Column:
    return F.count(F.when(predicate, F.lit(1)))


def adjusted_skewness(column: Column) -> Column:
    """Bias-adjusted sample skewness; Spark's built-in is the population form."""
    n = F.count(column).cast("double")
    return F.when(n > 2, F.skewness(column) * F.sqrt(n * (n - 1)) / (n - 2))


def row_digest(df: DataFrame, columns: list[str] | None = None) -> Column:
    """SHA-256 of a whole row: lets row equality be counted by shuffling 32 bytes per row."""
    from cleanloom.functions.columns import kinds, ref

    kind = kinds(df)
    exact = {f.name for f in df.schema.fields if isinstance(f.dataType, T.DecimalType)}
    parts = []
    for name in columns or df.columns:
        if kind[name] == "float" and name not in exact:
            value = (ref(name).cast("double") + F.lit(0.0)).cast("string")
        elif kind[name] == "other":
            value = F.to_json(F.struct(ref(name).alias("v")), {"ignoreNullFields": "false"})
        else:
            value = ref(name).cast("string")
        parts.append(F.coalesce(F.concat(F.length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def duplicate_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row (rows, distinct_rows, duplicate_rows); nulls compare equal."""
    groups = spread(df).select(row_digest(df, columns).alias("d")).groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.count(F.lit(1)).alias("distinct_rows"),
        (F.coalesce(F.sum("n"), F.lit(0)) - F.count(F.lit(1))).alias("duplicate_rows"),
    )


# ---------------------------------------------------------------- percentiles
def _ranks(fraction: float, n: int) -> tuple[int, int, float]:
    position = fraction * (n - 1)
    low = math.floor(position)
    return low, min(low + 1, n - 1), position - low


def percentiles(df: DataFrame, wanted: dict[str, tuple[Column, list[float]]], approximate: bool = False,
                in_memory: int = IN_MEMORY_VALUES, accuracy: int = SKETCH_ACCURACY) -> dict[str, list]:
    """Percentiles with linear interpolation, for several columns at once.

    ``wanted`` maps a name to (numeric column, fractions); nulls are ignored and a column without
    values gives ``None``. Small columns use the built-in exact percentile. Larger ones are answered
    exactly by rank selection: the pass that counts them also sketches them, the sketch brackets each
    rank, a pass counts the rows below and inside the brackets and sketches these in turn, and so on
    until the values inside fit in memory and one pass sorts them. That makes three passes up to about
    a hundred million values, and one more for every further factor of a hundred. A sketch only
    proposes brackets: counts decide. No state grows with the data.
    """
    if not wanted:
        return {}
    # Requests for the same column object share one aggregate.
    merged: dict[int, list] = {}
    for name, (column, fractions) in wanted.items():
        entry = merged.setdefault(id(column), [column, [], []])
        entry[1].append((name, len(entry[2]), len(fractions)))
        entry[2].extend(fractions)
    if len(merged) < len(wanted):
        found = percentiles(df, {i: (c, f) for i, (c, _, f) in merged.items()}, approximate, in_memory, accuracy)
        return {name: found[i][at:at + size] for i, (_, parts, _) in merged.items() for name, at, size in parts}
    keys = list(wanted)
    base = spread(df).select(*[wanted[k][0].cast("double").alias(f"v{i}") for i, k in enumerate(keys)])
    value = {k: F.col(f"v{i}") for i, k in enumerate(keys)}
    if approximate:
        found = aggregate(base, {
            k: F.percentile_approx(value[k], [float(p) for p in wanted[k][1]], F.lit(accuracy)) for k in keys})
        return {k: list(found[k]) if found[k] else [None] * len(wanted[k][1]) for k in keys}
    # The row count of a small table bounds every column's, and takes no column to find; others are counted and sketched at once.
    rows = df.count() if estimated_bytes(df) <= in_memory * BYTES_PER_VALUE else None
    if rows is not None and rows <= in_memory:
        counts, grids = dict.fromkeys(keys, rows), {}
    else:
        found = aggregate(base, {(k, "n"): F.count(value[k]) for k in keys} | {(k, "grid"): _grid(value[k], accuracy) for k in keys})
        counts, grids = ({k: found[(k, part)] for k in keys} for part in ("n", "grid"))
    small = {k: F.percentile(value[k], F.array(*[F.lit(float(p)) for p in wanted[k][1]]))
             for k in keys if 0 < counts[k] <= in_memory}
    passes = _bounded_passes(small, counts)
    large = [k for k in keys if counts[k] > in_memory]
    ranks, extra = {}, {}
    if large:
        asked = {(k, p): _ranks(p, counts[k]) for k in large for p in wanted[k][1]}
        first = passes.pop(0) if passes else {}
        ranks, extra = _select_ranks(base, value, counts, grids, {t: r[:2] for t, r in asked.items()}, in_memory, accuracy, first)
    for part in passes:
        extra |= aggregate(base, part)
    result: dict[str, list] = {k: list(extra[k]) if extra.get(k) is not None else [None] * len(wanted[k][1]) for k in keys}
    for k in large:
        result[k] = []
        for p in wanted[k][1]:
            low, high, weight = asked[(k, p)]
            a, b = ranks[(k, low)], ranks[(k, high)]
            result[k].append(a if a == b else a + (b - a) * weight)
    return result


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the size; file sizes where it reads files."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def _bounded_passes(expressions: dict, held: dict) -> list[dict]:
    """Aggregates that hold many values end up in one task: their sum is bounded in every pass."""
    passes: list[dict] = []
    filled = 0
    for key, expression in expressions.items():
        if not passes or filled + held[key] > PASS_VALUES:
            passes.append({})
            filled = 0
        passes[-1][key] = expression
        filled += held[key]
    return passes


def _grid(values: Column, accuracy: int) -> Column:
    """Evenly spaced quantiles of a mergeable sketch, its exact least and greatest values included; null without values."""
    sketch = F.kll_sketch_agg_double(F.when(~F.isnan(values), values), F.lit(accuracy))
    # One text to plan in place of a thousand literals.
    places = F.split(F.lit(",".join(str(i / GRID) for i in range(GRID + 1))), ",").cast("array<double>")
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, places))


@dataclass(frozen=True)
class _Bracket:
    """An open interval of values (``None``: no limit), the rows below it and the rows inside."""

    low: float | None
    high: float | None
    below: int
    inside: int

    def values(self, v: Column) -> Column:
        held = [v > F.lit(self.low)] if self.low is not None else []
        held += [v < F.lit(self.high)] if self.high is not None else []
        return F.when(reduce(and_, held), v) if held else v


def _select_ranks(base, value, counts, grids, asked, in_memory, accuracy, first) -> tuple[dict, dict]:
    """Exact order statistics {(key, 0-based rank): value}, and the results of the aggregates ``first``, which share the first pass.

    ``asked`` maps (key, fraction) to the two ranks it needs: neighbours, so they share brackets while they can. A bracket that
    fails to hold its rank is widened. An interval without its end values is strictly smaller, so the search ends.
    """
    reach = 3 * 2.3 / accuracy ** 0.9  # about three times the rank error the sketch states
    bracket = {(k, r): _Bracket(None, None, 0, counts[k]) for (k, _), ranks in asked.items() for r in ranks}
    middle = {(k, r): sum(ranks) / 2 for (k, _), ranks in asked.items() for r in ranks}
    wide = dict.fromkeys(bracket, reach)
    grid = {(k, _Bracket(None, None, 0, counts[k])): grids[k] for k, _ in bracket}
    answer: dict = {}
    searched, extra = set(bracket), {}
    while searched:
        guess = {}
        for t in list(searched):
            places = grid[(t[0], bracket[t])]
            if places is None:  # nothing but NaN is left, which is greater than any number
                answer[t] = math.nan
                searched.discard(t)
                continue
            share = (middle[t] - bracket[t].below) / max(bracket[t].inside - 1, 1)
            low = min(max(math.floor((share - wide[t]) * GRID), 0), GRID)
            high = max(min(math.ceil((share + wide[t]) * GRID), GRID), 0)
            guess[t] = (t[0], places[low] + 0.0, places[high] + 0.0)
        measures = {}
        for g in dict.fromkeys(guess.values()):
            v, low, high = value[g[0]], F.lit(g[1]), F.lit(g[2])
            measures |= {(g, "below"): count_if(v < low), (g, "inside"): count_if((v >= low) & (v <= high)),
                         (g, "at_low"): count_if(v == low), (g, "at_high"): count_if(v == high),
                         (g, "grid"): _grid(_Bracket(g[1], g[2], 0, 0).values(v), accuracy)}
        found = aggregate(base, measures | first) if measures or first else {}
        extra |= {k: found[k] for k in first}
        first = {}
        for t, g in guess.items():
            below, inside, at_low, at_high, inner = (found[(g, m)] for m in ("below", "inside", "at_low", "at_high", "grid"))
            rank, (_, low, high) = t[1], g
            if below <= rank < below + at_low:
                answer[t] = low
            elif below + inside - at_high <= rank < below + inside:
                answer[t] = high
            elif below <= rank < below + inside:
                bracket[t] = _Bracket(low, high, below + at_low, inside - at_low - at_high)
                grid[(t[0], bracket[t])], wide[t] = inner, reach
                if bracket[t].inside > in_memory:
                    continue
            elif wide[t] < 1:  # missed
                wide[t] *= 4
                continue
            else:  # beyond the greatest number
                answer[t] = math.nan
            searched.discard(t)
    ready: dict = {}
    for t in bracket:
        if t not in answer:
            ready.setdefault((t[0], bracket[t]), []).append(t)
    sorted_values = {at: F.array_sort(F.collect_list(at[1].values(value[at[0]]))) for at in ready}
    picked = {at: F.array(*[F.get(sorted_values[at], F.lit(t[1] - at[1].below)) for t in targets]) for at, targets in ready.items()}
    for part in _bounded_passes(picked, {at: at[1].inside for at in ready}):
        for at, values in aggregate(base, part).items():
            answer.update(zip(ready[at], values))
    return answer, extra


def median(df: DataFrame, column: Column, **options) -> float | None:
    return percentiles(df, {"m": (column, [0.5])}, **options)["m"][0]


# ---------------------------------------------------------------- value counts
def compact(column: Column, prefix: int = PREFIX) -> Column:
    """The text itself when short, else its first characters and a SHA-256 digest.

    No short text equals a compacted one: those are longer than the limit, and have at least ``prefix`` characters.
    """
    return F.when(F.octet_length(column) <= LONG_TEXT_BYTES // PREFIX * prefix, column).otherwise(
        F.concat(F.left(column, F.lit(prefix)), F.lit(DIGEST_MARK), F.sha2(column.cast("binary"), 256)))


def value_counts(df: DataFrame, columns: dict[str, Column], first_by: list[Column] | None = None, prefix: int = PREFIX) -> DataFrame:
    """Long form (column, value, n[, first_key]) of the non-null values of several text columns.

    A single pass feeds one two-level aggregation for all columns. Counts are combined before the
    shuffle, so a value held by a third of all rows costs one record per task. Long values are
    compacted; :func:`top_values` brings the few that are shown back.
    """
    names = list(columns)
    key = [F.struct(*first_by).alias("k")] if first_by else []
    # The values are worked out once, in a projection of their own, before they are compacted.
    base = spread(df).select(*[columns[name].alias(f"v{i}") for i, name in enumerate(names)], *key)
    pairs = F.explode(F.array(*[
        F.struct(F.lit(i).alias("c"), compact(F.col(f"v{i}"), prefix).alias("value")) for i in range(len(names))]))
    long = base.select(pairs.alias("p"), *(["k"] if first_by else [])).select(
        F.col("p.c").alias("c"), F.col("p.value").alias("value"), *(["k"] if first_by else [])).filter("value IS NOT NULL")
    aggs = [F.count(F.lit(1)).alias("n")] + ([F.min("k").alias("first_key")] if first_by else [])
    counted = long.groupBy("c", "value").agg(*aggs)
    label = F.get(F.array(*[F.lit(n) for n in names]), F.col("c"))
    return counted.select(label.alias("column"), "value", "n", *(["first_key"] if first_by else []))


def long_columns(df: DataFrame, columns: dict[str, Column]) -> list[str]:
    """Columns that hold a text long enough to be compacted; one cheap pass."""
    found = aggregate(df, {c: F.max(F.octet_length(e)) for c, e in columns.items()})
    return [c for c in columns if (found[c] or 0) > LONG_TEXT_BYTES]


def top_values(counts: DataFrame, n: int, by_first: bool = False, whole: tuple[DataFrame, dict[str, Column]] | None = None,
               long: list[str] | None = None) -> DataFrame:
    """At most ``n`` values per column, most frequent first (ties: smallest) or first seen.

    ``whole`` is the frame and the columns the values come from, ``long`` those of them that hold long texts, where that is known. With it,
    long texts are ordered and shown whole: the few that may be among the first get their texts back, and then they are ranked.
    """
    if whole:
        columns = {c: whole[1][c] for c in (long_columns(*whole) if long is None else long) if c in whole[1]}
        if columns:
            near = _contenders(counts, n, by_first, whole[0], columns)
            counts = counts.filter(~F.col("column").isin(*columns)).unionByName(_with_whole_texts(near, whole[0], columns, by_first))
    order = [F.col("first_key"), F.col("value")] if by_first else [F.col("n").desc(), F.col("value")]
    return (counts.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy(*order)))
            .filter(F.col("rank") <= n))


def _contenders(counts: DataFrame, n: int, by_first: bool, df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """The counted values of ``columns`` that may be among the first ``n``: fewer than n that surely are, and at most ``CONTENDERS`` that tie.

    Values are ranked by count (or place) and beginning; a task keeps n of them. What ties with the n-th is open. Where too many do,
    as with a column of texts that all begin alike, only the rows of that beginning are counted again, by a longer one.
    """
    by_value = by_first and dict(counts.dtypes)["first_key"] == "string"  # the value itself is what comes first
    names, need, level = list(counts.columns), dict.fromkeys(columns, n), PREFIX
    source, parts = _kept_counts(counts.filter(F.col("column").isin(*columns))), []
    while need:
        head = F.left("value", F.lit(level))
        tie = head if by_value else F.col("first_key") if by_first else -F.col("n")
        keyed = source.withColumn("__tie", tie).withColumn("__head", head)
        place = F.row_number().over(Window.partitionBy("column").orderBy("__tie", "__head"))
        wanted = F.coalesce(*[F.when(F.col("column") == c, k) for c, k in need.items()], F.lit(0))
        edges = keyed.withColumn("__place", place).filter(F.col("__place") <= n).filter(F.col("__place") == wanted).select(
            "column", F.struct("__tie", "__head").alias("__edge"))  # one row for each column
        keyed = keyed.join(F.broadcast(edges), "column", "left").withColumn("__at", F.struct("__tie", "__head"))
        sure, level_with = F.col("__edge").isNull() | (F.col("__at") < F.col("__edge")), F.col("__at") == F.col("__edge")
        told = keyed.groupBy("column").agg(F.count(F.when(sure, 1)).alias("sure"), F.count(F.when(level_with, 1)).alias("open"),
                                           F.max("__edge.__head").alias("head")).collect()
        # A place that is no text is the same for several values only where the given key repeats; these are few.
        deeper = {r["column"]: r for r in told if r["open"] > CONTENDERS and not (by_first and not by_value)}
        parts.append(keyed.filter(sure | (level_with & ~F.col("column").isin(*deeper))).select(*names))
        need = {c: need[c] - r["sure"] for c, r in deeper.items()}
        if need:
            level *= DEEPER
            again = {c: F.when(columns[c].startswith(r["head"]), columns[c]) for c, r in deeper.items()}
            rows = value_counts(df.filter(reduce(or_, [F.coalesce(e.isNotNull(), F.lit(False)) for e in again.values()])), again, prefix=level)
            if by_value:
                rows = rows.withColumn("first_key", F.col("value"))
            else:
                rows = rows.join(F.broadcast(edges.select("column", "__edge.__tie")), "column").filter(F.col("__tie") == -F.col("n")).drop("__tie")
            source = _kept_counts(rows.select(*names))
    return reduce(DataFrame.unionByName, parts)


def _kept_counts(counts: DataFrame) -> DataFrame:
    """Counted values on shared storage; several passes read them."""
    path = scratch_path(counts.sparkSession, "counted")
    counts.write.parquet(path)
    return counts.sparkSession.read.schema(counts.schema).parquet(path)


def _with_whole_texts(counts: DataFrame, df: DataFrame, columns: dict[str, Column], by_first: bool) -> DataFrame:
    """Counted values, few for each column, with the whole text in place of the compacted one."""
    names = list(columns)
    digest = F.when(F.col("value").contains(DIGEST_MARK), F.substring_index("value", DIGEST_MARK, -1))
    base = df.select(*[columns[c].alias(f"v{i}") for i, c in enumerate(names)])
    texts = base.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"v{i}").alias("whole")) for i, c in enumerate(names)])).alias("t"))
    texts = texts.select("t.*").filter(F.octet_length("whole") > LONG_TEXT_BYTES).withColumn("digest", F.sha2(F.col("whole").cast("binary"), 256))
    counts = counts.withColumn("digest", digest)
    asked = F.broadcast(counts.filter("digest IS NOT NULL").select("column", "digest"))  # bounded by CONTENDERS for each column
    found = texts.join(asked, ["column", "digest"], "left_semi").groupBy("column", "digest").agg(F.min("whole").alias("whole"))
    joined = counts.join(found, ["column", "digest"], "left")
    text = F.coalesce("whole", "value")
    first = [text.alias("first_key") if dict(counts.dtypes)["first_key"] == "string" else F.col("first_key")] if by_first else []
    kept = [c for c in counts.columns if c not in ("column", "value", "first_key", "digest")]
    return joined.select("column", text.alias("value"), *kept, *first)


def distinct_counts(df: DataFrame, columns: dict[str, Column], approximate: bool = False) -> dict[str, int]:
    """Distinct non-null values per text column: one shuffle of distinct (column, value) pairs."""
    if not columns:
        return {}
    if approximate:
        return aggregate(df, {c: F.approx_count_distinct(e) for c, e in columns.items()})
    counted = value_counts(df, columns).groupBy("column").agg(F.count(F.lit(1)).alias("d")).collect()
    return dict.fromkeys(columns, 0) | {row["column"]: row["d"] for row in counted}


def clean_modes(df: DataFrame, columns: dict[str, Column]) -> dict[str, dict]:
    """Most frequent value (ties: smallest), its count, and the total and distinct counts."""
    if not columns:
        return {}
    counts = value_counts(df, columns)
    # The top entry is a maximum over (count, reversed value order): combined before the shuffle.
    per_column = counts.groupBy("column").agg(
        F.max("n").alias("top"), F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct"),
        F.min_by("value", F.struct((-F.col("n")).alias("a"), F.col("value").alias("b"))).alias("mode"))
    found = {r["column"]: r.asDict() for r in per_column.collect()}
    long = {c: columns[c] for c in long_columns(df, columns)}
    if long:
        top = top_values(value_counts(df, long), 1, whole=(df, long), long=list(long))
        for row in top.collect():
            found[row["column"]]["mode"] = row["value"]
    empty = {"mode": None, "top": 0, "total": 0, "distinct": 0}
    return {name: found.get(name, dict(empty)) for name in columns}
