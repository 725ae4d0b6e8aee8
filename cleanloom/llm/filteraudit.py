"""How quality filters interact, kept up to date by a stream with retractions.

Five filters are judged on whole texts: A to D on the text alone, E (a repeat of a smaller id's text) against the whole table. The mask of a
document is the set of filters it fails, and everything the report says follows from the number of documents per (part, mask).

The stream reads all files as available-now micro-batches of ``CORE_BYTES`` a core. A file's rows become small records: digest of the text (MD5, 128 bits), id, part, labels
and the mask of A to D. Of the records of one text that meet in one Arrow batch only the smallest id can still pass E; the others are known to fail
it and are dealt by their id, so a text that a third of all rows hold reaches its key as one record per batch of rows. Keyed state holds, for every text,
its smallest id so far and the documents of each part and label that stand there. Texts share a key by slices of their digest, ``SLICE_BYTES`` of files
each, so that a slice is one vectorised step. When a smaller id arrives, in the same micro-batch or a later one, the documents of the old one are
retracted from their counter and counted again with E. The stream writes these changes, +n or -n for a (part, mask, good, toxic), to a transactional file
sink; state and progress lie in the shared folder, so a lost executor or a restart repeats a micro-batch and counts nothing twice. Counters are the
sums of the changes.

The report sums the counters for every filter and every set of filters before it (80 pairs) and gives each of the 120 orders its five pairs.
The Shapley value needs no orders: of all orders, a document is removed by a given one of its k failing filters in 120 / k.

Defined cases: null text is empty, and empty texts equal each other; a null source is the part '', as is an empty source; rows without id never fail E and
make no other row fail; rows that repeat their id and text at the smallest id all pass E; of several labels of an id, any good and any toxic one counts, null
labels count for nothing; rows without id have no label; an empty table gives an empty report; columns beside id, text and source are not read.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cleanloom.llm.common import ref, whole_text
from cleanloom.session import scratch_path

FILTERS = "ABCDE"
FEWEST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2  # the last two in percent
JUNK = r"[#$%&*|]"
BLANKS = " \t\n\x0b\f\r"
REPEAT = 1 << FILTERS.index("E")
CORE_BYTES = 32 << 20  # of files that a micro-batch holds for each core
SLICE_BYTES = 4 << 20  # of files whose texts share a key of the state
STATE_BYTES = 1 << 30  # of files whose slices share a partition of the state
SALTS = 1024
AT_LEAST, REPEATED, ALONE = 0, 1, 2  # kinds of records: at the smallest id of its batch, known to fail E, without id
RECORD = "d1 long, d2 long, kind int, id long, part string, mask int, n long"
CHANGE = "part string, mask int, good boolean, toxic boolean, n long"
STATE = "packed binary"


# ---------------------------------------------------------------- masks
def text_mask(text: Column) -> Column:
    """The filters A to D that a text fails, as bits."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{BLANKS}]+"))
    count, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = [count < FEWEST_WORDS, 100 * distinct.cast("long") < LEAST_DISTINCT * count.cast("long"),
             100 * capitals.cast("long") > MOST_CAPITALS * F.length(text).cast("long"), text.rlike(JUNK)]
    mask = F.lit(0)
    for bit, fail in enumerate(fails):
        mask = mask.bitwiseOR(F.when(fail, 1 << bit).otherwise(0))
    return mask


def label_flags(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, good, toxic): a row per labelled id."""
    flag = lambda name: F.coalesce(F.max(ref(name) == 1), F.lit(False)).alias(name)
    return (labels.filter(ref(id_col).isNotNull()).groupBy(ref(id_col).cast("long").alias("id"))
            .agg(flag("quality").alias("good"), flag("toxic").alias("toxic")))


# ---------------------------------------------------------------- stream
def _records(batches):
    """Records of an Arrow batch; rows that repeat text, id and part are one. Batches are read in file order, so a repeated task makes the same records."""
    for batch in batches:
        if not len(batch):
            continue
        found = batch.astype({"id": "Int64"}).groupby(["digest", "id", "part", "mask"], sort=False, dropna=False).size().rename("n").reset_index()
        halves = np.frombuffer(bytes.fromhex("".join(found["digest"])), ">i8").astype(np.int64).reshape(-1, 2)
        least = found["id"] == found.groupby("digest")["id"].transform("min")  # of the ids that are there
        kind = np.where(found["id"].isna(), ALONE, np.where(least.fillna(False).astype(bool), AT_LEAST, REPEATED)).astype(np.int32)
        yield pd.DataFrame({"d1": halves[:, 0], "d2": halves[:, 1], "kind": kind, "id": found["id"], "part": found["part"], "mask": found["mask"], "n": found["n"]})


def settled(held: pd.DataFrame | None, fresh: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(what stands at the smallest id of each text now, changes of the counters) after ``fresh`` records join ``held``."""
    moving = fresh[fresh["kind"] == AT_LEAST]
    rest = fresh[fresh["kind"] != AT_LEAST]
    both = pd.concat([moving.assign(old=False)] + ([] if held is None else [held.assign(old=True)]), ignore_index=True)
    least = both["id"] == both.groupby(["d1", "d2"])["id"].transform("min")
    late = both[~least]
    turns = [both[least & ~both["old"]], late.assign(mask=late["mask"] | REPEAT),  # first count, or counted again with E
             late[late["old"]].assign(n=lambda x: -x["n"]),  # a smaller id has come: retracted
             rest.assign(mask=rest["mask"] | np.where(rest["kind"] == REPEATED, REPEAT, 0))]
    counter, standing = ["part", "mask", "good", "toxic"], ["d1", "d2", "id", "part", "mask", "good", "toxic"]
    changed = pd.concat([t[[*counter, "n"]] for t in turns]).groupby(counter, sort=False, as_index=False)["n"].sum()
    return both[least].groupby(standing, sort=False, as_index=False)["n"].sum(), changed


def _settle(key, frames, state: GroupState):
    """One slice of texts in one micro-batch."""
    held = pa.ipc.open_stream(state.get[0]).read_pandas() if state.exists else None
    fresh = pd.concat([frame.drop(columns="slice") for frame in frames])
    held, changed = settled(held, fresh)
    if len(held):
        packed = pa.BufferOutputStream()
        rows = pa.Table.from_pandas(held, preserve_index=False)
        with pa.ipc.new_stream(packed, rows.schema) as out:
            out.write_table(rows)
        state.update((packed.getvalue().to_pybytes(),))
    yield changed.astype({"mask": "int32"})


def changes(docs: DataFrame, flags: DataFrame, slices: int, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """The stream of changes to the counters, from a stream of documents."""
    text = whole_text(text_col)
    rows = docs.select(F.md5(text.cast("binary")).alias("digest"), ref(id_col).cast("long").alias("id"),
                       F.coalesce(ref(part_col).cast("string"), F.lit("")).alias("part"), text_mask(text).alias("mask")).mapInPandas(_records, RECORD)
    # Rows without id match no label; a salt spreads them over the tasks of the join.
    rows = rows.withColumn("key", F.coalesce("id", F.lit(0))).withColumn(
        "salt", F.when(F.col("id").isNull(), F.pmod(F.xxhash64("d1"), F.lit(SALTS)) + 1).otherwise(0).cast("int"))
    known = rows.join(flags.withColumn("salt", F.lit(0)).withColumnRenamed("id", "key"), ["key", "salt"], "left")
    dealt = F.when(F.col("kind") == AT_LEAST, F.col("d1")).otherwise(F.xxhash64("key", "d2"))
    return known.select(F.pmod(dealt, F.lit(slices)).alias("slice"), "d1", "d2", "kind", F.coalesce("id", F.lit(0)).alias("id"), "part", "mask",
                        *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")], "n").groupBy("slice").applyInPandasWithState(
        _settle, CHANGE, STATE, "append", GroupStateTimeout.NoTimeout)


def counters(spark: SparkSession, path: str, labels: DataFrame, core_bytes: int = CORE_BYTES, **columns) -> DataFrame:
    """(part, mask, good, toxic, n): the sums of all changes that the files under ``path`` bring, however they fall into micro-batches."""
    files = spark.read.parquet(path)
    size = int(files._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    cores = spark.sparkContext.defaultParallelism
    slices = max(16 * cores, -(-size // SLICE_BYTES))
    session = spark.newSession()  # the number of state partitions is fixed by the first micro-batch, and is this stream's alone
    session.conf.set("spark.sql.shuffle.partitions", str(max(cores, -(-size // STATE_BYTES))))
    where = {name: scratch_path(spark, f"audit-{name}") for name in ("labels", "changes", "progress")}
    label_flags(labels).write.parquet(where["labels"])  # written once, not worked out again in every micro-batch
    path = f"{path.rstrip('/')[:-1]}[{path.rstrip('/')[-1]}]"  # as a pattern, a path may name a single file as well as a folder
    stream = session.readStream.schema(files.schema).option("maxBytesPerTrigger", str(core_bytes * cores)).parquet(path)
    query = (changes(stream, session.read.parquet(where["labels"]), slices, **columns).writeStream.format("parquet").outputMode("append")
             .option("path", where["changes"]).option("checkpointLocation", where["progress"]).trigger(availableNow=True).start())
    try:
        query.awaitTermination()
    finally:
        query.stop()
    found = spark.read.schema(CHANGE).parquet(where["changes"])  # by the sink's log: files of committed micro-batches only
    return found.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")).filter("n <> 0")


# ---------------------------------------------------------------- report
def report(counts: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) from counters."""
    pairs, orders = [], []
    for bit in range(len(FILTERS)):
        pairs += [(1 << bit, before) for before in range(1 << len(FILTERS)) if not before >> bit & 1]
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, bit in enumerate(order, 1):
            orders.append(("".join(FILTERS[i] for i in order), step, 1 << bit, before))
            before |= 1 << bit
    spark = counts.sparkSession
    orders = spark.createDataFrame(orders, "filter_order string, step int, own int, before int")
    pair = F.explode(F.array(*[F.struct(F.lit(own).alias("own"), F.lit(before).alias("before")) for own, before in pairs]))
    met = counts.select("part", "mask", "good", "toxic", "n", pair.alias("pair")).select("*", "pair.*")
    mask, own, before = F.col("mask"), F.col("own"), F.col("before")
    fails, earlier = mask.bitwiseAND(own) != 0, mask.bitwiseAND(before) != 0
    lost = fails & ~earlier
    total = lambda condition, value=F.col("n"): F.sum(F.when(condition, value).otherwise(0)).cast("long")
    sums = met.groupBy("part", "own", "before").agg(
        total(mask.bitwiseAND(own.bitwiseOR(before)) == 0).alias("kept"), total(lost).alias("removed"), total(fails & earlier).alias("redundant"),
        total(mask == own).alias("unique_fails"), total(lost & F.col("good")).alias("good_lost"), total(lost & F.col("toxic")).alias("toxic_lost"),
        total(fails, F.col("n") * F.expr("120 div greatest(bit_count(mask), 1)")).alias("shapley"))
    return sums.join(F.broadcast(orders), ["own", "before"]).drop("own", "before")  # 600 rows, whatever the data


def audit(spark: SparkSession, path: str, labels: DataFrame, **options) -> DataFrame:
    """The report on the documents in the parquet files under ``path``."""
    return report(counters(spark, path, labels, **options))
