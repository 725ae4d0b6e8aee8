"""SimHash near-duplicates found by Golay-code fuzzy hashing.

Fingerprint: texts in lower case (A-Z only) are cut into words, ``shingle`` words in a row are hashed by
XXH64, and a bit of the fingerprint is set if it is set in over half of the hashes, repeats included. A text
with fewer words has one shingle, its whole word sequence; a text without words has fingerprint zero.

Fingerprints are linked when they differ in at most two bits. Candidates come from keys:

* The 64 bits are cut into three segments. Two errors cannot touch all three, so one segment is the same in
  both fingerprints (pigeonhole), and the next segment carries at most two errors.
* That next segment is decoded in the perfect binary Golay code (23 bits, 12 of them data, 3 errors corrected):
  the codeword indices of the segment and of all segments one bit away. Two segments with at most two errors
  have a point in the middle, one bit or less from both, so they share an index. Most segments give six indices.

A key is (which segment agrees, its bits, a codeword index of the next). Fingerprints with a key in common are
compared bit by bit. Keys are dealt to tasks and sorted, never gathered: a key with more than ``BUCKET`` distinct
fingerprints is not paired up at all. Its members meet exactly instead: each is sent to itself and the 64
fingerprints one bit away, and two are linked just when they arrive at a common point. A point has at most 65
visitors, so this is linear in the members and loses no link.

Equal texts collapse to one fingerprint before any of this; components come from star contraction.

Defined cases: null text counts as empty; empty texts are linked like any other equal fingerprints; rows
without id get their component's smallest id, which is null only if no member has one; repeated rows are
linked; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cleanloom.llm.common import keep_rows, ref, shuffle_partitions, stored
from cleanloom.llm.components import components

SHINGLE = 3
SEED = 42
BUCKET = 16
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # (lowest bit, bits)
CHUNK = 1 << 16  # shingles counted at a time
GOLAY_LENGTH, GOLAY_CHECKS = 23, 11
GOLAY_POLYNOMIAL = 0xAE3  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


# ---------------------------------------------------------------- fingerprints
def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of a whole text as an unsigned number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed=SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
    ends = ends[shingle - 1:].tolist()
    counts, total = np.zeros(64, np.int64), len(starts)
    for at in range(0, total, CHUNK):
        pieces = [joined[a:b] for a, b in zip(starts[at:at + CHUNK], ends[at:at + CHUNK])]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), "<u8", len(pieces))
        bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, tag, fp): a row per input row; tag is a hash of its text, fp the fingerprint as a signed number."""
    def run(batches):
        for batch in batches:
            found = np.fromiter((fingerprint(t, shingle) for t in batch["text"]), np.uint64, len(batch))
            yield pd.DataFrame({"id": batch["id"], "tag": batch["tag"], "fp": found.view(np.int64)})

    rows = docs.select(ref(id_col).cast("long").alias("id"), F.xxhash64(ref(text_col)).alias("tag"), ref(text_col).alias("text"))
    return rows.mapInPandas(run, "id long, tag long, fp long")


# ---------------------------------------------------------------- Golay keys
def _remainder(words: np.ndarray) -> np.ndarray:
    left = words.astype(np.uint32)
    for bit in range(GOLAY_LENGTH - 1, GOLAY_CHECKS - 1, -1):
        left = np.where(left >> bit & 1, left ^ np.uint32(GOLAY_POLYNOMIAL << (bit - GOLAY_CHECKS)), left)
    return left


def _error_table() -> np.ndarray:
    """The error pattern of up to three bits that belongs to each remainder."""
    single = (1 << np.arange(GOLAY_LENGTH)).astype(np.uint32)
    patterns = {0}
    for _ in range(3):
        patterns |= {p | int(s) for p in patterns for s in single}
    patterns = np.array(sorted(patterns), np.uint32)
    table = np.zeros(1 << GOLAY_CHECKS, np.uint32)
    table[_remainder(patterns)] = patterns
    return table


_ERRORS = _error_table()


def codeword_index(words: np.ndarray) -> np.ndarray:
    """The 12 data bits of the codeword nearest to each 23-bit word."""
    return (words ^ _ERRORS[_remainder(words)]) >> GOLAY_CHECKS


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, position of its fingerprint) of all keys of unsigned fingerprints, each key once per fingerprint."""
    keys, owners = [], []
    for j, (low, bits) in enumerate(SEGMENTS):
        next_low, next_bits = SEGMENTS[(j + 1) % len(SEGMENTS)]
        same = fps >> np.uint64(low) & np.uint64((1 << bits) - 1)
        near = (fps >> np.uint64(next_low) & np.uint64((1 << next_bits) - 1)).astype(np.uint32)
        flips = np.concatenate([[0], 1 << np.arange(next_bits)]).astype(np.uint32)
        found = np.sort(codeword_index((near[:, None] ^ flips).ravel()).reshape(len(fps), -1), axis=1)
        first = np.ones(found.shape, bool)
        first[:, 1:] = found[:, 1:] != found[:, :-1]
        owner, column = np.nonzero(first)
        keys.append(np.uint64(j) << np.uint64(40) | same[owner] << np.uint64(12) | found[owner, column].astype(np.uint64))
        owners.append(owner)
    return np.concatenate(keys), np.concatenate(owners)


def _emit_keys(batches):
    for batch in batches:
        fps = batch["fp"].to_numpy(np.int64)
        for at in range(0, len(fps), CHUNK):
            part = fps[at:at + CHUNK]
            keys, owners = golay_keys(part.view(np.uint64))
            yield pd.DataFrame({"key": keys.view(np.int64), "fp": part[owners]})


def _verified(keys: np.ndarray, fps: np.ndarray, bits: int, bucket: int):
    """Linked pairs of rows sorted by key, and the members of keys too large to pair up."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    large = np.repeat(np.diff(np.append(starts, len(keys))) > bucket, np.diff(np.append(starts, len(keys))))
    yield fps[large], fps[large]
    keys, fps = keys[~large], fps[~large]
    for step in range(1, bucket):
        near = np.flatnonzero(keys[step:] == keys[:-step])
        if not len(near):
            return
        near = near[np.bitwise_count((fps[near] ^ fps[near + step]).view(np.uint64)) <= bits]
        yield fps[near], fps[near + step]


def _pair_up(bits: int, bucket: int):
    def run(batches):
        """Rows arrive sorted by key; the last key of a batch waits for the next one."""
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            keys = np.concatenate([keys, batch["key"].to_numpy(np.int64)])
            fps = np.concatenate([fps, batch["fp"].to_numpy(np.int64)])
            whole = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if len(keys) - whole > bucket:  # already large: let most of it go, and keep it large
                whole = len(keys) - bucket - 1
            if whole:
                yield from _frames(keys[:whole], fps[:whole], keys[whole:], bits, bucket)
                keys, fps = keys[whole:], fps[whole:]
        if len(keys):
            yield from _frames(keys, fps, keys[:0], bits, bucket)

    return run


def _frames(keys, fps, waiting, bits, bucket):
    open_key = len(waiting) and keys[-1] == waiting[0]
    if open_key:  # the head of a large key that goes on: its members are known to be large
        head = keys == keys[-1]
        yield pd.DataFrame({"a": fps[head], "b": fps[head]})
        keys, fps = keys[~head], fps[~head]
    for a, b in _verified(keys, fps, bits, bucket) if len(keys) else ():
        yield pd.DataFrame({"a": a, "b": b})


# ---------------------------------------------------------------- links and components
def _meeting_links(large: DataFrame) -> DataFrame:
    """Links between members of large keys, through the points one bit away."""
    points = F.concat(F.array(F.col("fp")), F.transform(
        F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    visits = large.select("fp", F.explode(points).alias("point"))
    met = visits.groupBy("point").agg(F.collect_list("fp").alias("members")).filter(F.size("members") > 1)  # 65 at most
    return met.select(F.array_min("members").alias("a"), F.explode("members").alias("b")).filter("a <> b")


def links(nodes: DataFrame, bits: int = 2, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links that connect just the distinct fingerprints (column fp) up to ``bits`` (2 at most) apart."""
    if bits not in (1, 2):
        raise ValueError("the keys are complete for one or two differing bits")
    keys = nodes.select("fp").mapInPandas(_emit_keys, "key long, fp long")
    dealt = keys.repartition(shuffle_partitions(nodes.sparkSession), "key").sortWithinPartitions("key", "fp")
    found = stored(dealt.mapInPandas(_pair_up(bits, bucket), "a long, b long").distinct(), "links")
    large = found.filter("a = b").select(F.col("a").alias("fp"))
    met = _meeting_links(large) if bits == 2 else _one_bit_links(large)
    return found.filter("a <> b").union(met)


def _one_bit_links(large: DataFrame) -> DataFrame:
    """For one bit, a point one bit away must itself be a member."""
    points = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(
        F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    visits = large.select(F.col("fp").alias("a"), F.explode(points).alias("b"))
    return visits.join(large.withColumnRenamed("fp", "b"), "b", "left_semi").select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 2,
                    shingle: int = SHINGLE) -> DataFrame:
    """(id, tag, fp, root, component_id): a row per input row; the component's id is its smallest document id."""
    rows = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = stored(rows.groupBy("fp").agg(F.min("id").alias("first")), "nodes")
    roots = components(links(nodes, bits))
    linked = nodes.join(roots.withColumnRenamed("vertex", "fp"), "fp")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    settled = linked.join(least, "root").select("fp", "root", "least")
    classes = stored(nodes.join(settled, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"),
        F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("least")).alias("component_id")), "classes")
    return rows.join(classes, "fp").select("id", "tag", "fp", "root", "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each component stays, one with the smallest id, with all its columns."""
    best = near_duplicates(docs, id_col, text_col, **options).filter(F.col("id").eqNullSafe(F.col("component_id")))
    kept = best.withColumn("nth", F.row_number().over(Window.partitionBy("root").orderBy("tag"))).filter("nth = 1")
    return keep_rows(docs, {"id": ref(id_col).cast("long"), "tag": F.xxhash64(ref(text_col))}, kept.select("id", "tag"))
