"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, target / size of its source, held as
an integer number of 2**-20 copies. Within a source the documents stand in a fixed order; the expected
copies are summed along it, one offset per source is added, and a document is emitted once for each
whole number that its step of the running sum crosses. So a document is taken floor or ceil of its
expected copies, and never more often than ``most`` times.

The order is (number of binary digits of the size, hash of the id, id): neighbours are of similar size, so
an even step along the order takes an even share of short and long documents, and the words taken come near
the target. The running sum is built from cells (source, size class, slice of the hash), summed per cell
first and then across the cells of a source, so that a source with a third of all rows is not one
sort. The number of slices follows spark.sql.shuffle.partitions, and the result does not depend on it:
slices are ranges of the hash, and all sums are whole numbers.

Targets: sources by code point, null last, weigh ``weights`` in turn. The wanted total is shared by weight;
a source stops at ``most`` times its size and its excess is shared again among the others. Each round is one
global aggregate of two numbers over the table of sources.

Defined cases: null text has size 0; null source is a source of its own; a source without words has
target 0 and gives nothing; rows without ``doc_id`` are ordered first; repeated rows are documents of
their own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cleanloom.llm.common import WORD, ref, shuffle_partitions, stored

WEIGHTS = (5, 2, 1)
MOST = 3
UNIT_BITS = 20  # expected copies are counted in 2**-20
HASH_HEX = 7  # hex digits of the order hash that decide the slice
OFFSET_SEED = "mix:"


def words(name: str = "text") -> Column:
    return F.coalesce(F.regexp_count(ref(name), F.lit(WORD)), F.lit(0)).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """Add the source's place in code point order. One row per source passes here, never a document."""
    return sources.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, weight, target) from rows (source, size)."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    held = stored(_ranked(totals).withColumn("weight", weight).drop("place"), "sources")
    whole = held.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    rate, limit = 0.0, F.col("source_size") * most
    stopped = F.lit(False)
    while True:
        row = held.agg(F.coalesce(F.sum(F.when(stopped, limit)), F.lit(0)).alias("given"),
                       F.sum(F.when(~stopped, F.col("weight"))).alias("weight")).first()
        if row["weight"] is None:
            break
        found = (whole - row["given"]) / row["weight"]
        if found <= rate:
            break
        rate = found
        stopped = F.col("weight") * F.lit(rate) > limit
    return held.withColumn("target", F.least(F.col("weight") * F.lit(rate), limit.cast("double")))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          weights=WEIGHTS, most: int = MOST, seed: str = OFFSET_SEED, extra: tuple[str, ...] = ()) -> DataFrame:
    """A row per document: id, source, size, source_size, target, copies, and the columns named in ``extra``, their names led by x_."""
    named = ref(source_col).cast("string")
    rows = docs.select(ref(id_col).alias("id"), named.alias("source"),
                       F.coalesce(F.concat(F.lit("="), named), F.lit("")).alias("src"),  # the source, never null
                       words(text_col).alias("size"), *[ref(c).alias(f"x_{c}") for c in extra])
    targets = source_targets(rows, weights, most)
    slices = max(1, shuffle_partitions(docs.sparkSession) // 4)
    unit = 1 << UNIT_BITS
    digest = F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary"))
    rows = rows.withColumn("h", digest).select(
        "*", F.length(F.bin("size")).alias("class"),
        F.shiftright(F.conv(F.substring("h", 1, HASH_HEX), 16, 10).cast("long") * slices, 4 * HASH_HEX).alias("slice"))
    # The step of a source, its offset, and how many documents come before each cell.
    cells = rows.groupBy("src", "class", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("src").orderBy("class", "slice").rowsBetween(Window.unboundedPreceding, -1)
    step = F.least(F.floor(F.col("target") / F.col("source_size") * unit), F.lit(most * unit)).cast("long")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col("source"), F.lit(""))).cast("binary")), 1,
                                UNIT_BITS // 4), 16, 10).cast("long")
    steps = targets.select(F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("src"), "source_size", "target",
                           F.when(F.col("source_size") > 0, step).otherwise(F.lit(0)).alias("step"), offset.alias("offset"))
    cells = (cells.withColumn("skipped", F.coalesce(F.sum("n").over(before), F.lit(0)))
             .join(steps, "src").drop("n"))
    along = (Window.partitionBy("src", "class", "slice").orderBy("h", "id", "size")
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = rows.withColumn("nth", F.count(F.lit(1)).over(along)).join(cells, ["src", "class", "slice"])
    upto = F.col("step") * (F.col("skipped") + F.col("nth")) + F.col("offset")
    copies = F.shiftright(upto, UNIT_BITS) - F.shiftright(upto - F.col("step"), UNIT_BITS)
    return placed.select("id", "source", "size", "source_size", "target", copies.alias("copies"),
                         *[ref(f"x_{c}") for c in extra])


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns it came with."""
    plan = mixed(docs, extra=tuple(docs.columns), **options)
    return (plan.filter("copies > 0")
            .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
            .select(*[ref(f"x_{c}").alias(c) for c in docs.columns]))
